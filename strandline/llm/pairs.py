"""Problem 5: question and answer pairs whose answer is useless for training are flagged with the defect.

Method: a suffix automaton of each prompt measures how much of the response is copied from it; refusal automata,
delimiter stacks and stopword-language votes find the other defects. Whether an answer without final punctuation
breaks off is judged by how its last words stand in all answers: at the end of sentences, or only within them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import clean_role, says_something
from strandline.llm.language import SETS, language
from strandline.session import durable, lookup_join

# What stands in place of an answer.
PLACEHOLDERS = frozenset("n a,na,null,none,nil,nan,no answer,no response,awaiting data ingestion,awaiting,undefined,empty,tbd,todo,pending,placeholder,sin respuesta,pendiente,keine antwort,pas de réponse,sans réponse,blank,missing".split(","))

# Phrases by which an answer declines, without case, accents kept, single spaces.
REFUSALS = (
    "can't help with", "cannot help with", "can not help with", "can't assist", "cannot assist", "unable to help", "unable to assist", "unable to answer", "unable to provide", "unable to comment",
    "not able to answer", "not able to help", "not able to share", "not able to discuss", "not able to comment", "won't be able to share", "won't be able to answer", "won't be able to help", "won't be able to discuss",
    "cannot provide", "can't provide", "cannot answer", "can't answer", "cannot share", "can't share", "cannot discuss", "can't discuss", "cannot comment", "can't comment", "i must decline", "have to decline", "must decline to",
    "i decline to", "i'd rather not", "i would rather not", "prefer not to", "don't feel comfortable", "do not feel comfortable", "not comfortable discussing", "my guidelines", "off limits", "outside what i may", "outside what i can", "outside my limits", "ask a professional", "consult a professional",
    "wouldn't be appropriate", "would not be appropriate", "not appropriate for me", "no way to comment", "no comment on this", "as an assistant i", "as an ai", "as a language model", "not allowed to", "not permitted to",
    "no puedo ayudarte", "no puedo ayudar con", "no puedo responder", "no puedo contestar", "no puedo compartir", "no puedo proporcionar", "no puedo hablar de", "no puedo opinar", "no me es posible", "no es posible responder", "no estoy en condiciones", "no me siento cómodo", "no me siento cómoda", "prefiero no", "preferiría no",
    "debo abstenerme", "me abstengo", "mis normas", "mis directrices", "fuera de mis límites", "no las puedo atender", "no la puedo atender", "no lo puedo atender", "consultar a un profesional", "no sería apropiado", "no es apropiado", "mejor no digo nada", "no tengo permitido", "no me está permitido", "como asistente no", "como modelo de lenguaje", "me impiden entrar", "tengo que declinar", "debo declinar",
    "je ne peux pas répondre", "je ne peux pas vous aider", "je ne peux pas t'aider", "je ne peux pas aider", "je ne peux pas partager", "je ne peux pas fournir", "je ne peux pas en parler", "je préfère ne pas", "je préférerais ne pas", "il ne m'est pas possible", "je ne suis pas en mesure", "je ne suis pas autorisé", "je dois m'abstenir", "je dois décliner", "en tant qu'assistant", "mes règles", "à un professionnel", "pas approprié", "hors de mes limites", "je ne me sens pas à l'aise",
    "nicht helfen", "nicht beantworten", "darf ich darauf nicht", "darauf nicht antworten", "dazu nichts sagen", "möchte ich dazu nicht", "darüber nicht sprechen", "darf ich nicht", "ich darf nicht", "nicht weiterhelfen", "bin ich nicht in der lage", "ich bin nicht in der lage", "als assistent", "meine richtlinien", "meine regeln", "nicht angemessen", "keine auskunft", "muss ich ablehnen", "lieber nicht",
)

# How one says that one cannot, may not or will not, and what one then does not do, by language; every
# combination declines. German puts the verb last, after `nicht`.
UNWILLING = {
    "en": "can't,cannot,can not,couldn't,could not,am unable to,i'm unable to,not able to,won't,will not,won't be able to,will not be able to,not allowed to,not permitted to,not authorised to,not authorized to,not in a position to,not going to,not willing to,refuse to,must refuse to,decline to,prefer not to,rather not,not comfortable to",
    "es": "no puedo,no podré,no podemos,no voy a,no debo,no quiero,no quisiera,no me corresponde,me niego a,no estoy autorizado a,no estoy autorizada a,no se me permite,no tengo permiso para,no soy capaz de,prefiero no,me es imposible",
    "fr": "je ne peux pas,je ne peux,je ne pourrai pas,je ne veux pas,je ne dois pas,je ne vais pas,je ne saurais,je refuse de,il m'est impossible de,je n'ai pas le droit de,je ne suis pas en mesure de,je ne suis pas habilité à,on ne me permet pas de",
    "de": "nicht",
}
DECLINED = {
    "en": "help with,help you,assist,answer,respond to,reply to,provide,share,discuss,comment,advise,disclose,reveal,go into that,talk about that,engage with,get into that,speak to that,fulfil,fulfill,comply",
    "es": "responder,contestar,ayudar,ayudarte,ayudarle,compartir,proporcionar,opinar,comentar,hablar de eso,hablar de ello,hablar sobre,atender,revelar,divulgar,entrar en ese,darte esa,dar esa,facilitar,aconsejar,responderte,contestarte",
    "fr": "répondre,y répondre,vous répondre,te répondre,vous aider,t'aider,aider,partager,fournir,commenter,en parler,en discuter,divulguer,révéler,donner cette,vous conseiller,te conseiller,traiter cette",
    "de": "helfen,weiterhelfen,beantworten,antworten,mitteilen,preisgeben,kommentieren,äußern,besprechen,verraten,weitergeben,eingehen,beraten,behilflich sein,darüber reden,dazu äußern",
}

# Words with which a sentence that thanks or apologises opens.
COURTESY = frozenset("thank thanks sorry apologies apologise apologize gracias agradezco siento perdón perdona disculpa merci désolé désolée pardon danke leid entschuldigung entschuldige".split())

# Words that name a language a question may ask to be answered in.
ASKED = {
    "en": "english inglés anglais englisch", "es": "spanish español espagnol spanisch castellano", "fr": "french francés français französisch", "de": "german alemán allemand deutsch",
}
_ASK = {w: lang for lang, words in ASKED.items() for w in words.split()}
_ASK_VERB = re.compile(r"\b(?:answer|reply|respond|write|translate|say|respond\w*|respónd\w*|contest\w*|contést\w*|traduc\w*|tradú\w*|escrib\w*|escríb\w*|répond\w*|réponse|traduis\w*|écri\w*|antwort\w*|übersetz\w*|schreib\w*)\b")
_ASK_IN = re.compile(r"\b(?:in|en|auf|to|al|ins)\s+(\w+)")

_TOKEN = re.compile(r"\w+(?:'\w+)?")
_SENTENCE, _CLAUSE = re.compile(r"(?<=[.!?…])[\"»”')\]]*\s+|\n+"), re.compile(r"[,;:–—]\s+|\s[–—-]\s")
_LIST_STUB = re.compile(r"(?:^|\n)[ \t]*(?:\d+[.)]|[-*•–])[ \t]*$")
_ITEM = re.compile(r"\n[ \t]*(?:[-*•–]|\d+[.)])[ \t]+[^\n]*$")
_OPEN, _CLOSE = "([{«“„", ")]}»”“"
#: Words may end an answer if at least this share of their places in all answers are ends: the last two words, or the
#: last one where the two never stand together. Shares, so that verdicts do not depend on how many answers there are.
END_RATE, WORD_RATE = 0.01, 0.5


class SuffixAutomaton:
    """All word runs of a prompt; `longest` walks a response and gives the copied run that ends at each word."""

    def __init__(self, words: list[str]):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for w in words:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def longest(self, words: list[str]) -> list[int]:
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                state, n = 0, 0
            out.append(n)
        return out


def copied(question: list[str], answer: list[str], most_new: int = 2, sentences: list[list[str]] | None = None) -> bool:
    """Whether the answer says nothing beyond the question.

    That is so where runs of the question cover all of the answer but `most_new` words (a lead such as "you asked"),
    and make up at least six tenths of the question; or where all but those words are whole sentences of the question
    in a row, of WHOLE words or more. Fewer or broken words of a question may well answer it.
    """
    if sentences and _whole_sentences(sentences, answer, most_new):
        return True
    if not question or not answer or len(answer) > 2 * len(question) + most_new:
        return False
    # Runs hold words of the question only, so too many other words settle it without them.
    if len(answer) - sum(map(set(question).__contains__, answer)) > most_new:
        return False
    runs = SuffixAutomaton(question).longest(answer)
    covered = [False] * len(answer)
    i = len(answer) - 1
    while i >= 0:
        n = runs[i]
        for k in range(i - n + 1, i + 1):
            covered[k] = True
        i -= max(n, 1)
    known = sum(covered)
    return len(answer) - known <= most_new and known >= 0.6 * len(question) and known >= 2 * (len(answer) - known)


#: Words that sentences of the question must have for an answer that repeats them to be a copy.
WHOLE = 5


def _whole_sentences(sentences: list[list[str]], answer: list[str], most_new: int) -> bool:
    """Whether neighbouring sentences, whole, make up all of the answer but `most_new` words."""
    first = size = 0
    for last, words in enumerate(sentences):
        size += len(words)
        while size > len(answer):
            size -= len(sentences[first])
            first += 1
        for a in range(first, last + 1):
            run = [w for x in sentences[a : last + 1] for w in x]
            if len(run) < max(WHOLE, len(answer) - most_new):
                break
            if any(answer[i : i + len(run)] == run for i in range(len(answer) - len(run) + 1)):
                return True
    return False


@functools.lru_cache(maxsize=1)
def _refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    combined = (f"{x} {y}" for lang, xs in UNWILLING.items() for x in xs.split(",") for y in DECLINED[lang].split(","))
    for phrase in (*REFUSALS, *combined):
        a.add_word(f" {phrase}", phrase)
    a.make_automaton()
    return a


def _parts(answer: str) -> list[str]:
    """Sentences and lines; those of more than 40 words by their clauses."""
    out = []
    for part in _SENTENCE.split(answer):
        out += _CLAUSE.split(part) if part.count(" ") > 40 else [part]
    return out


def refuses(question: list[str], answer: str, automaton: ahocorasick.Automaton) -> bool:
    """Whether the answer declines, wherever it does, rather than holding such a phrase in passing.

    Sentences that thank, apologise or restate the question tell nothing. Of the others, the first or second must
    decline, or a quarter of them all.
    """

    def flat(text: str) -> str:
        return " " + re.sub(r"[^\w']+", " ", text.lower().replace("’", "'")).strip() + " "

    if next(automaton.iter(flat(answer)), None) is None:
        return False
    asked = {w for w in question if len(w) > 3}
    declining = telling = 0
    for part in _parts(answer):
        bare = flat(part)
        words = bare.split()
        if not words:
            continue
        if next(automaton.iter(bare), None) is not None:
            if telling <= 1:
                return True
            declining += 1
            continue
        content = [w for w in words if len(w) > 3]
        if not COURTESY.isdisjoint(words[:3]) or len(content) >= 2 and 2 * sum(w in asked for w in content) >= len(content):
            continue
        telling += 1
    return 3 * declining >= telling and declining > 0


def unclosed(answer: str) -> bool:
    """Whether a bracket or quotation is open at the end."""
    stack = []
    for ch in answer:
        if ch in "([{«“":
            stack.append(ch)
        elif ch in ")]}»”" and stack:
            stack.pop()
    return bool(stack)


def asked_language(question: str) -> str | None:
    """The language the question asks to be answered in, if it does."""
    low = question.lower()
    if not _ASK_VERB.search(low):
        return None
    for m in _ASK_IN.finditer(low):
        if m[1] in _ASK:
            return _ASK[m[1]]
    return None


def judge(question: str | None, answer: str | None, said: bool, ends: int, n: int, last_ends: int, last_n: int, automaton) -> str | None:
    """The defect of one pair, or None. The counts tell how the last two words and the last word stand in all answers."""
    bare = " ".join(_TOKEN.findall(unicodedata.normalize("NFKC", answer or "").lower()))
    if answer is None or not said or not bare or bare in PLACEHOLDERS:
        return "empty"
    question = question or ""
    words_q = [w.lower() for w in _TOKEN.findall(unicodedata.normalize("NFKC", question))]
    words_a = bare.split(" ")
    known = set(words_q)
    if sum(w not in known for w in words_a) <= 2:
        sentences = [x for x in ([w.lower() for w in _TOKEN.findall(unicodedata.normalize("NFKC", part))] for part in _SENTENCE.split(question)) if x]
        copy = copied(words_q, words_a, sentences=sentences)
    else:
        copy = False
    if copy:
        return "copy"
    if refuses(words_q, answer, automaton):
        return "refusal"
    text = answer.rstrip()
    core = text.rstrip(" \n\t\u200b\u200e\ufeff")
    if _LIST_STUB.search(core):
        return "truncated"
    open_end = broken_end(core)
    lang_q, lang_a = language(question), language(answer)
    wanted = asked_language(question)
    if lang_a and lang_q and lang_a != lang_q and lang_a != wanted:
        return "other_language"
    if open_end is None:
        return None
    if open_end == "broken" or unclosed(core):
        return "truncated"
    if n:
        return None if ends >= END_RATE * n else "truncated"
    function = any(words_a[-1] in known for known in SETS.values())
    return None if last_n and not function and last_ends >= WORD_RATE * last_n else "truncated"


def broken_end(core: str) -> str | None:
    """None: ends like a sentence or a complete text; "broken": ends in a comma or the like; "open": to be judged by its words."""
    tail = re.sub(r"[\s\"'»”)\]]+$", "", core)
    if re.search(r"[.!?]$", tail) and not tail.endswith("..."):
        return None
    if re.search(r"[,;:(\[{«“–—/&-]$", core) and not re.search(r"[:;]-?[)(DP]$", core):
        return "broken"
    return "open"


# -- Spark side ------------------------------------------------------------------------------------------------------

_END, _INNER_DOT, _SPLIT = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s|$)|\n|$"), re.compile(r"[^\w.']+|(?<=\S)\.(?=\S)"), re.compile(r"\s+")
_CLOSED = re.compile(r"[.!?][\s\"'»”)\]]*$")


def pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, question, answer): each user turn with the assistant turn numbered one higher.

    Roles ignore case and outer spaces. Rows repeated with other contents count once, with the greatest content; rows
    without conv_id, turn_no or role are left out. One pre-aggregated shuffle, no join.
    """
    role = clean_role(F.col("role"))
    turns = conversations.where("conv_id is not null and turn_no is not null").select("conv_id", F.when(role == "assistant", F.col("turn_no") - 1).otherwise(F.col("turn_no")).cast("int").alias("turn_no"), role.alias("role"), "content")
    grouped = turns.where(F.col("role").isin("user", "assistant")).groupBy("conv_id", "turn_no").agg(
        F.max(F.col("role") == "user").alias("asked"),
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("question"),
        F.max(F.when(F.col("role") == "assistant", F.col("content"))).alias("answer"),
    )
    return grouped.where("asked").drop("asked")


def marked(text: str) -> list[str]:
    """Words of the text, without case, with a `.` after each sentence or line."""
    return [w for w in _SPLIT.split(_INNER_DOT.sub(" ", _END.sub(" . ", text.lower()))) if w]


def last_words(answer: str | None) -> tuple[str, str] | None:
    """The last two words of an answer that does not end like a sentence; '.' stands for the beginning of a sentence or line."""
    if not answer or _CLOSED.search(answer):
        return None
    words = [".", *marked(answer)]
    while words and words[-1] == ".":
        words.pop()
    return (words[-2] if len(words) > 1 else ".", words[-1]) if words else None


def _count_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word pairs of each batch of answers, pre-aggregated: (prev, last, ends, n)."""
    for pdf in batches:
        n, ends = Counter(), Counter()
        for text in pdf["answer"]:
            # The end of a text without punctuation tells nothing and is no end here.
            cut = max(text.rfind(c) for c in ".!?…\n") + 1
            words = [".", *marked(text[:cut])]
            pairs_ = list(zip(words, words[1:], strict=False))
            n.update(pairs_)
            ends.update(p for p, after in zip(pairs_, [*words[2:], ""], strict=True) if after == ".")
        found_ = [(p, w, ends[p, w], k) for (p, w), k in n.items() if w != "."]
        yield pd.DataFrame(found_, columns=["prev", "last", "ends", "n"])


def endings(answers: DataFrame) -> DataFrame:
    """(prev, last, ends, n): how often each word pair stands in all answers, and how often at the end of a sentence.

    prev is '.' for the first word of a sentence or line, and '' for counts of the last word alone.
    """
    counted = answers.where("answer is not null").select("answer").mapInPandas(_count_ends, "prev string, last string, ends long, n long")
    counted = durable(counted.groupBy("prev", "last").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n")), "p5-endings")
    alone = counted.groupBy("last").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n")).select(F.lit("").alias("prev"), "last", "ends", "n")
    return counted.unionByName(alone)


@F.pandas_udf(T.StructType([T.StructField("prev", T.StringType()), T.StructField("last", T.StringType())]))
def _last_words(answer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([last_words(x if isinstance(x, str) else None) or (None, None) for x in answer], columns=["prev", "last"], dtype=object)


def defects(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, defect) of each pair, defect null where the pair is sound. One row per user turn."""
    # Only answers that do not end like a sentence need the counts; the others have null keys.
    rows = pairs(conversations).withColumn("k", _last_words("answer"))
    keyed = durable(rows.select("conv_id", "turn_no", F.struct("conv_id", "turn_no").alias("id"), "question", "answer", "k.prev", "k.last"), "p5-pairs")
    table = endings(keyed)
    two = table.where("prev != ''").select("prev", "last", "ends", "n")
    one = table.where("prev = ''").select("last", F.col("ends").alias("last_ends"), F.col("n").alias("last_n"))
    joined = lookup_join(lookup_join(keyed, two, ["prev", "last"], "id", ["ends", "n"]), one, ["last"], "id", ["last_ends", "last_n"])
    judged = _judge_udf()(F.col("question"), F.col("answer"), says_something(F.col("answer")), *[F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("ends", "n", "last_ends", "last_n")])
    return joined.select("conv_id", "turn_no", judged.alias("defect"))


def _judge_udf():
    @F.pandas_udf("string")
    def run(question: pd.Series, answer: pd.Series, said: pd.Series, ends: pd.Series, n: pd.Series, last_ends: pd.Series, last_n: pd.Series) -> pd.Series:
        automaton = _refusal_automaton()
        clean = lambda s: [None if x is None or x != x else x for x in s]
        return pd.Series([judge(*x, automaton) for x in zip(clean(question), clean(answer), said, ends, n, last_ends, last_n, strict=True)], dtype=object)

    return run


def found(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, defect) of the defective pairs."""
    return defects(conversations).where("defect is not null")
