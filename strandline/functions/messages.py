"""Keys, roles and patterns of messages, as JVM-side column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations that hold both ways.
SYMMETRIC = ("communicates_with", "cousin_of", "coworker_of", "friend_of", "romantic_partner", "sibling_of", "spouse_of")
# The vector room of each source type; others go to hall_voice.
HALL_FACTS = ("obsidian", "markdown", "pdf", "plaintext", "gbrain", "gbrain-export")
# Personal data patterns in the order in which they are counted and redacted.
PII = {
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "password": r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*\S+",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
}
# How preferences are told, for and against.
PREFERENCE = r"(?iu)\b(?:me\s+gust\w*|me\s+encant\w*|amo\b|adoro\b|prefier\w*|mi\s+favorit[oa]|i\s+like\b|i\s+love\b|my\s+favou?rite)\b"
NEGATIVE_PREFERENCE = r"(?iu)\b(?:no\s+me\s+gust\w*|no\s+me\s+encant\w*|i\s+(?:do\s+not|don't)\s+like)\b"
# Words that carry no topic in a question, and those that ask for a preference.
STOP_WORDS = "a about al and are como con cosas cuál cuáles de del does el ella en es esta este for hacer he her him is la las le les lo los me mi my of para por que qué se she sobre su sus tiene tener the to un una what who y".split()
PREFERENCE_WORDS = "gusta gustan gustar encanta encantan prefiere preferir favorito favorita like likes love loves prefer favorite".split()
SPANISH_MARKERS = "qué cuál cuáles cómo dónde cuando cuándo quién le sus sobre gusta gustan prefiere favorito favorita".split()


def strip(col: Column) -> Column:
    """Without white space of any kind at the ends; Spark's trim knows only the space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def label_role(label: Column, persona: str = "") -> Column:
    """assistant for assistant, bot, ai, system, no label at all or the persona's name; user otherwise."""
    low = strip(F.lower(label))
    role = F.when(low.isin("assistant", "bot", "ai", "system"), "assistant").when(low.isin("user", "human"), "user")
    if persona:
        role = role.when(F.contains(low, F.lit(persona.lower())), "assistant")
    return role.when(F.coalesce(label, F.lit("")) == "", "assistant").otherwise("user")


def persona_role(sender: Column, persona: str, exact: bool = False) -> Column:
    """assistant where the sender is the persona (its name within the sender's, or all of it), user otherwise."""
    key = persona.strip().lower()
    if not key:
        return F.lit("user")
    low = strip(F.lower(sender))
    return F.when((low == key) if exact else F.contains(low, F.lit(key)), "assistant").otherwise("user")


def content_hash(role: Column, content: Column, *, source_type: Column | None = None, subject: Column | None = None, kind: Column | None = None, authority: Column | None = None) -> Column:
    """First 16 hex digits of sha256 of `role:content`; manual context also counts subject, kind and authority."""
    base = F.concat_ws(":", F.coalesce(role, F.lit("")), F.coalesce(content, F.lit("")))
    if source_type is not None:
        key = F.concat_ws(":", base, *[strip(F.lower(F.coalesce(c, F.lit("")))) for c in (subject, kind, authority)])
        base = F.when(source_type == "user_context", key).otherwise(base)
    return F.substring(F.sha2(base, 256), 1, 16)


def vector_id(slug: Column, hash16: Column) -> Column:
    return F.concat_ws("-", slug, hash16)


def claim_id(subject: Column, predicate: Column, obj: Column) -> Column:
    """A relation's id: the same however its ends are written, and whichever comes first where it holds both ways."""
    a, b, p = (strip(F.lower(c)) for c in (subject, obj, predicate))
    both = predicate.isin(*SYMMETRIC)
    key = F.concat_ws("|", F.when(both, F.least(a, b)).otherwise(a), p, F.when(both, F.greatest(a, b)).otherwise(b))
    return F.concat(F.lit("base-"), F.substring(F.sha2(key, 256), 1, 16))


def hall(source_type: Column) -> Column:
    return F.when(source_type.isin(*HALL_FACTS), "hall_facts").otherwise("hall_voice")


def pii_counts(text: Column) -> dict[str, Column]:
    """Matches per kind in the text as it is; kinds may overlap."""
    return {label: F.regexp_count(text, F.lit(p)) for label, p in PII.items()}


def pii_redact(text: Column) -> Column:
    """Each kind replaced in turn, later kinds seeing what earlier ones left."""
    for label, p in PII.items():
        text = F.regexp_replace(text, p, f"[REDACTED_{label.upper()}]")
    return text


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than two letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-záéíóúüñ]+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(kept)


def question_terms(question: str, without: list[str] | None = None) -> list[str]:
    """`terms` of a literal question, in Python, without those of other texts."""
    words = re.findall("[a-záéíóúüñ]+", question.lower())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOP_WORDS and w not in set(without or ())))


def term_overlap(question: list[str], text: Column) -> Column:
    """How many question terms stand in the text, as they are or by their first five letters (of five or more): one pattern a
    term, over the text in lower case; nothing is split."""
    low, edge = F.lower(text), "a-záéíóúüñ"
    out = F.lit(0)
    for t in question:
        if len(t) >= 5:
            # A stop word is no term of the text, though it may begin as one.
            stops = "|".join(w[5:] for w in STOP_WORDS if len(w) >= 5 and w.startswith(t[:5]))
            word = re.escape(t[:5]) + (rf"(?!(?:{stops})(?![{edge}]))" if any(w.startswith(t[:5]) for w in STOP_WORDS if len(w) >= 5) else "")
        else:
            word = rf"{re.escape(t)}(?![{edge}])"
        out = out + low.rlike(rf"(?<![{edge}]){word}").cast("int")
    return out


def lexical_overlap(question: Column, content: Column) -> Column:
    """The same for arrays of terms."""
    hit = lambda t: F.array_contains(content, t) | ((F.length(t) >= 5) & F.exists(content, lambda w: (F.length(w) >= 5) & w.startswith(F.substring(t, 1, 5))))
    return F.size(F.filter(question, hit))


def iso(ts: Column) -> Column:
    """ISO text without zone; fractions only where there are any."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""))


def epoch_iso(number: Column) -> Column:
    """ISO text of a number of seconds, or of milliseconds where it exceeds 1e12."""
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return iso(F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
