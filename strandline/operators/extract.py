"""Persons and relations told in messages, and how well they are found (KG-04..07, KG-09, AG-14)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import ranked

# Confidences by how a name was found, and the least that counts.
FLOOR, KNOWN, EXPLICIT, CONTEXT, COREFERENCE, MULTIWORD = 0.80, 0.99, 0.96, 0.90, 0.84, 0.82
#: Messages without mention over which a pronoun still refers to the last one.
REACH = 2
# A capitalised Latin word, and a run of one to six.
TOKEN = r"[A-ZÁÉÍÓÚÑÜ][a-záéíóúñü]+"
NAME = rf"(?P<name>{TOKEN}(?:\s+{TOKEN}){{0,5}})"
# Words that are no part of a name.
NO_NAMES = frozenset("ahora ayer buenas buenos chat después domingo ella enero febrero gracias he hola hoy jueves lunes mañana martes miércoles mensaje november sábado san santa se she sistema system viernes whatsapp".split())
# How relations are stated: what stands before the name, and the relation.
STATED = {
    r"my\s+friend|mi\s+amig[oa]": "friend_of",
    r"my\s+(?:brother|sister)|mi\s+herman[oa]": "sibling_of",
    r"my\s+(?:mom|dad|mother|father)|mi\s+(?:mamá|madre|papá|padre)": "parent_of",
    r"my\s+(?:wife|husband)|mi\s+espos[oa]": "spouse_of",
    r"my\s+partner|mi\s+pareja": "partner_of",
    r"my\s+boss|mi\s+jef[ea]": "reports_to",
    r"my\s+(?:colleague|coworker)|mi\s+(?:colega|compañer[oa](?:\s+de\s+trabajo)?)": "colleague_of",
}
# Contexts in which a name stands.
AROUND = [
    rf"\b(?:with|told|asked|met|called|texted|emailed)\s+{NAME}\b",
    rf"\b(?:con|(?:le\s+)?dije\s+a|pregunté\s+a|conocí\s+a|llamé\s+a|escribí\s+a|hablé\s+con|mensajeé\s+a)\s+{NAME}\b",
    rf"(?i)\b(?:hola|oye|gracias|querid[oa])[,]?\s+{NAME}\b",
    rf"\b{NAME}\s+(?:me\s+(?:dijo|preguntó|llamó|escribió)|(?:said|asked|called|wrote)\b)",
]
# How a pronoun is said to stand in a relation.
PRONOUN = {r"amig[oa]?": "friend_of", r"jef[ea]?": "reports_to", r"(?:colega|coworker|colleague)": "colleague_of", r"(?:pareja|partner)": "partner_of"}
MANY_WORDS = rf"\b(?P<name>{TOKEN}(?:\s+{TOKEN}){{1,5}})\b"


@dataclass(frozen=True)
class Rule:
    """A pattern whose group `name` is a candidate, with what it tells of it.

    known: what it tells where the candidate holds a known name; None: the same. inside: not where a sentence begins.
    """

    pattern: re.Pattern
    confidence: float
    method: str
    relation: str | None = None
    known: tuple[float, str] | None = None
    inside: bool = False


RULES = [
    *[Rule(re.compile(rf"\b(?i:{lead})\s+{NAME}\b"), EXPLICIT, "explicit-relationship", relation) for lead, relation in STATED.items()],
    *[Rule(re.compile(p), CONTEXT, "context-ner") for p in AROUND],
    Rule(re.compile(MANY_WORDS), MULTIWORD, "multiword-ner", known=(KNOWN, "known-identity-expanded"), inside=True),
]
PRONOUN_RULES = [(re.compile(rf"\b(?:ella|él|she|he)\s+(?:es|is)\s+(?:mi|my)\s+{noun}\b", re.IGNORECASE), relation) for noun, relation in PRONOUN.items()]
_EDGES = re.compile(r"\w+")


class Known:
    """The known names of an archive that a message may hold, found by their first word."""

    def __init__(self, names):
        self.names = {n for n in names if n}
        self.low = {n.casefold() for n in self.names}
        self.by_first: dict[str, list[str]] = {}
        for n in sorted(self.names):
            if first := _EDGES.search(n.casefold()):
                self.by_first.setdefault(first[0], []).append(n)

    def said(self, content: str) -> Iterator[str]:
        """Those that stand in the content as whole words, case aside."""
        low = content.casefold()
        for m in _EDGES.finditer(low):
            for n in self.by_first.get(m[0], ()):
                lead = _EDGES.search(n.casefold()).start()
                at, end = m.start() - lead, m.start() - lead + len(n.casefold())
                if at >= 0 and low.startswith(n.casefold(), at) and not re.match(r"\w", low[end : end + 1]) and not (at and re.match(r"\w", low[at - 1])):
                    yield n

    def expand(self, name: str) -> str | None:
        """KG-04: the known name whose words stand in `name` in order; the longest, if there is one longest."""
        words = name.casefold().split()
        fits: dict[int, list[str]] = {}
        for k in {k for w in words for k in self.by_first.get(w, ())}:
            rest = iter(words)
            if all(w in rest for w in k.casefold().split()):
                fits.setdefault(len(k.split()), []).append(k)
        longest = fits.get(max(fits, default=0), [])
        return longest[0] if len(longest) == 1 else None

    def accepts(self, name: str) -> bool:
        """KG-05: 80 characters at most, and known, or one to three capitalised words none of which is ruled out."""
        words = name.split()
        shaped = 0 < len(words) <= 3 and all(re.fullmatch(TOKEN, w) and w.casefold() not in NO_NAMES for w in words)
        return 0 < len(name) <= 80 and (name.casefold() in self.low or shaped)


def tidy(name: str) -> str:
    return " ".join(name.split()).strip(".,:;!?¿¡()[]{}")


def _candidates(content: str, known: Known) -> Iterator[tuple[str, float, str, str | None]]:
    """(name, confidence, method, relation) of every span that a rule points to."""
    for n in known.said(content):
        yield n, KNOWN, "known-identity", None
    for rule in RULES:
        for m in rule.pattern.finditer(content):
            whole = known.expand(m["name"])
            if whole and rule.known:
                yield whole, *rule.known, rule.relation
            elif not rule.inside or m.start() and content[: m.start()][-2:] not in (". ", "! ", "? "):
                yield whole or m["name"], rule.confidence, rule.method, rule.relation


def facts(content: str, known: Known, recent: str | None = None) -> tuple[list[tuple[str, float, str]], list[tuple[str, str, float]]]:
    """KG-06: (mentions by falling confidence: name, confidence, method; relations: name, relation, confidence).

    recent: the name a pronoun refers to, if any.
    """
    found = [(tidy(n), c, method, relation) for n, c, method, relation in _candidates(content, known)]
    found = [f for f in found if known.accepts(f[0])]
    if recent:
        found += [(recent, COREFERENCE, "bounded-coreference", relation) for p, relation in PRONOUN_RULES if p.search(content)]
    # Of the mentions of one name the surest counts, the first of equally sure ones.
    mentions = {}
    for place, (name, confidence, method, _) in enumerate(found):
        if confidence >= FLOOR:
            mentions[name.casefold()] = max(mentions.get(name.casefold(), (0.0, 0, "", "")), (confidence, -place, name, method))
    ranked = sorted(mentions.values(), key=lambda x: (-x[0], x[2].casefold()))
    return [(name, c, method) for c, _, name, method in ranked], [(name, relation, c) for name, c, _, relation in found if relation]


# A sender's state is the last name mentioned and how many messages ago, REACH + 1 standing for all beyond. What a run of
# messages does to it is told by where it leads from each age: to a name of its own, or to the one it came with.
State = tuple[str | None, int]
_COLUMNS = [x for age in range(REACH + 2) for x in (f"own{age}", f"age{age}")]


def _step(state: State, content: str, known: Known, plain: tuple | None = None) -> tuple[State, tuple]:
    """The state after a message, and its facts."""
    name, age = state
    told = facts(content, known, name) if name is not None and age <= REACH and any(p.search(content) for p, _ in PRONOUN_RULES) else plain or facts(content, known)
    if told[0]:
        return (told[0][0][0], 0), told
    return (name, min(age + 1, REACH + 1)), told


_OUT = "slug string, seq long, sender string, kind string, name string, relation string, confidence double, method string"


def _known_of(names) -> Known:
    return Known(names if names is not None else ())


#: Stands for the name a run came with.
_CAME = "\x00"


def _effects(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one block of a sender's messages does to each state."""
    ends: list[State] = [(_CAME, age) for age in range(REACH + 2)]
    for content, names in zip(pdf["content"], pdf["known"], strict=True):
        known = _known_of(names)
        plain = facts(content, known)
        ends = [_step(e, content, known, plain)[0] for e in ends]
    row = {"slug": pdf["slug"].iloc[0], "key": pdf["key"].iloc[0], "block": pdf["block"].iloc[0]}
    for age, (name, after) in enumerate(ends):
        row[f"own{age}"], row[f"age{age}"] = None if name == _CAME else name, after
    return pd.DataFrame([row])


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of a sender, from the effects of those before it: one row a block."""
    name, age, out = None, REACH + 1, []
    for row in pdf.sort_values("block").to_dict("records"):
        out.append((row["slug"], row["key"], row["block"], name, age))
        own = row[f"own{age}"]
        name, age = own if isinstance(own, str) else name, int(row[f"age{age}"])
    return pd.DataFrame(out, columns=["slug", "key", "block", "name", "age"])


def extract(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """KG-07: what assistant messages tell, with pronouns resolved to the sender's last mention up to two messages back.

    messages: slug, seq, role, sender, content; participants: slug, name. One row per mention and relation. A message
    meets only the names of its archive whose first word it holds. What a pronoun means depends on all that the sender said
    before; a sender's messages lie in blocks (see operators.ordered), each of which tells what it does to any state, and
    the states at the blocks' beginnings follow from those, so no sender has to fit into one task.
    """
    said = messages.where(F.col("role") == "assistant").select("slug", "seq", F.trim(F.coalesce("sender", F.lit(""))).alias("sender"), F.coalesce("content", F.lit("")).alias("content")).withColumn("key", F.lower("sender"))
    words = said.select("slug", "seq", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("first"))
    names = participants.where("name is not null and name != ''").select("slug", "name", F.regexp_extract(F.lower("name"), r"(?U)(\w+)", 1).alias("first")).distinct()
    held = words.join(names, ["slug", "first"]).groupBy("slug", "seq").agg(F.array_sort(F.collect_set("name")).alias("known"))
    placed = ranked(said.join(held, ["slug", "seq"], "left"), ["slug", "key"], [F.col("seq")], "facts").withColumnsRenamed({"__block": "block", "__rank": "rank"})
    group = ["slug", "key", "block"]
    schema = "slug string, key string, block int, " + ", ".join(f"{c} {'string' if c.startswith('own') else 'int'}" for c in _COLUMNS)
    placed = placed.where("slug is not null")
    # A sender inside one block begins with nothing; only those that span blocks need the effects of these.
    spanning = placed.groupBy("slug", "key").agg(F.min("block").alias("a"), F.max("block").alias("z")).where("a < z").select("slug", "key")
    effects = placed.join(spanning, ["slug", "key"], "left_semi").groupBy(*group).applyInPandas(lambda pdf: _effects(pdf.sort_values("rank")), schema)
    starts = effects.groupBy("slug", "key").applyInPandas(_starts, "slug string, key string, block int, name string, age int")
    rows = placed.join(starts, group, "left").withColumn("age", F.coalesce("age", F.lit(REACH + 1))).repartition(*group).sortWithinPartitions(*group, "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, (None, REACH + 1)
        for pdf in batches:
            out = []
            for slug, key, block, seq, sender, content, names_, name, age in zip(*[pdf[c] for c in ("slug", "key", "block", "seq", "sender", "content", "known", "name", "age")], strict=True):
                if at != (slug, key, block):
                    at, state = (slug, key, block), (name if isinstance(name, str) else None, int(age))
                state, (found, relations) = _step(state, content, _known_of(names_))
                out += [(slug, seq, sender, "mention", n, None, c, m) for n, c, m in found]
                out += [(slug, seq, sender, "relation", n, r, c, "explicit-relationship" if c == EXPLICIT else "bounded-coreference") for n, r, c in relations]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")])

    return rows.mapInPandas(run, _OUT)


def valid_from(stamp: Column) -> Column:
    """KG-09: the date a stamp begins with, else null."""
    return F.nullif(F.regexp_extract(stamp, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def evaluate(cases: DataFrame) -> DataFrame:
    """AG-14: one row of counts, precision, recall and F1 of (expected, actual) string arrays; 1 where there is nothing to divide by."""
    low = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower))
    c = cases.select(low("expected").alias("e"), low("actual").alias("a"))
    n = c.agg(
        F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum(F.size(F.array_intersect("a", "e"))), F.lit(0)).alias("true_positive"), F.coalesce(F.sum(F.size(F.array_except("a", "e"))), F.lit(0)).alias("false_positive"), F.coalesce(F.sum(F.size(F.array_except("e", "a"))), F.lit(0)).alias("false_negative")
    )
    share = lambda x, y: F.when(x + y > 0, x / (x + y)).otherwise(1.0)
    tp, fp, fn = (F.col(k) for k in ("true_positive", "false_positive", "false_negative"))
    p, r = share(tp, fp), share(tp, fn)
    return n.withColumns({"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1": F.bround(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)})
