"""Function words of the four languages of the data, and votes by them."""

from __future__ import annotations

import re

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at for with without from by about as is are was were be been being have has had do does did not no this that these those it its i you he she we they my your his her our their me him them us who what which when where why how if whether than then so because although though after before during while into over under between out off would could should will can may might must there here also just very more most some any all each every other".split(),
    "es": "el la los las un una unos unas y e o u pero de del al a en con sin por para que como es son era fue fueron ser estar está estaba he ha han había hay no ni se me te le lo les nos mi tu su mis tus sus nuestro yo tú él ella ellos ellas quien quién qué cuál cuando cuándo donde dónde cómo si sí muy más menos ya aunque porque entre sobre hasta desde durante antes después también esto esta este ese esa eso aquel todo toda todos otra otro cuánto".split(),
    "fr": "le la les un une des et ou mais de du au aux à en dans sur avec sans pour par que qui quoi dont où est sont était étaient être avoir a ai as ont avait ne pas plus se me te lui leur nous vous je tu il elle ils elles on mon ma mes ton ta tes son sa ses notre votre ce cet cette ces cela ça comme si quand comment pourquoi parce alors ensuite après avant pendant chez entre très aussi même autre tout toute tous y d l j n s c qu m t".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber von vom zu zum zur in im an am auf aus bei beim mit ohne für durch über unter nach vor während seit bis um ist sind war waren sein haben habe hat hatte hatten wird werden wurde nicht kein keine ich du er sie es wir ihr mich dich ihn uns mir dir ihm mein meine meinen dein deine ihre unser sich dass ob wenn als wie was wer wo warum wann welche weil obwohl dann auch noch nur schon sehr mehr alle andere jemand etwas".split(),
}
#: Each language's words; those of several languages vote for each of them.
SETS = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*SETS.values())
WORD = re.compile(r"[^\W\d_]+")


def votes(words: list[str]) -> dict[str, float]:
    """Share of the words that are function words, by language."""
    if not words:
        return dict.fromkeys(SETS, 0.0)
    telling = [w for w in words if w in _ANY]
    return {lang: sum(map(known.__contains__, telling)) / len(words) for lang, known in SETS.items()}


def language(text: str, lead: float = 0.06) -> str | None:
    """The language with the most votes where it leads the next by `lead`, else None."""
    words = WORD.findall(text.lower())
    ranked = sorted(votes(words).items(), key=lambda x: -x[1])
    return ranked[0][0] if words and ranked[0][1] - ranked[1][1] >= lead else None
