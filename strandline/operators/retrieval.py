"""Retrieval and its gates (RET-01, RET-04..13, RET-15, RET-17, TK-01, TK-02, PRJ-09, PRJ-10)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import NEGATIVE_PREFERENCE, PREFERENCE, PREFERENCE_WORDS, SPANISH_MARKERS, collapse, question_terms, term_overlap

# Weights, the least score that supports an answer, and sizes.
SEMANTIC, LEXICAL, SUPPORT, EXCERPT, BUDGET, LIMIT = 0.8, 0.2, 0.42, 500, 2500, 5


def candidates(limit: int) -> int:
    """TK-02: how many hits are fetched for a limit."""
    return min(max(6 * limit, 20), 100)


def language(question: Column) -> Column:
    """PRJ-10: es where a question opens with ¿ or has a Spanish marker word, en otherwise."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"([a-záéíóúüñ]+)"), F.lit(1))
    return F.when(F.contains(question, F.lit("¿")) | F.arrays_overlap(words, F.array(*map(F.lit, SPANISH_MARKERS))), "es").otherwise("en")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double arithmetic; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """RET-01, TK-01: the k vectors of the least distance (1 - cosine), ids breaking ties; the filter applies before. Exact."""
    pool = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return pool.withColumn("distance", 1 - cosine(F.col("embedding"), q)).where("distance is not null").orderBy("distance", "id").limit(k)


def semantic(distance: Column) -> Column:
    """RET-05: 1 - distance within 0 and 1; nothing for no number."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)), F.lit(0.0))


def topic_terms(question: str, participant: str) -> list[str]:
    """RET-04: terms of the question without the participant's name and words that ask for preferences."""
    return question_terms(question, [*question_terms(participant), *PREFERENCE_WORDS])


def asks_preference(question: str) -> bool:
    return bool(set(re.findall(r"\w+", question.lower())) & set(PREFERENCE_WORDS))


def score(hits: DataFrame, question: str, participant: str, budget: int = BUDGET) -> DataFrame:
    """RET-07: hits (content, distance, ...) with overlap, prefers, score and excerpt; hits without text are dropped."""
    q = topic_terms(question, participant)
    over = term_overlap(q, F.col("content"))
    s = hits.withColumns({"overlap": over, "asked": F.lit(len(q)), "prefers": F.col("content").rlike(PREFERENCE), "excerpt": F.rtrim(F.substring(collapse(F.col("content")), 1, min(EXCERPT, budget)))})
    return s.where("excerpt != ''").withColumn("score", SEMANTIC * semantic(F.col("distance")) + LEXICAL * F.when(F.col("asked") > 0, F.col("overlap") / F.col("asked")).otherwise(0.0))


def select_within(ranked: DataFrame, by: list[str], order: list[Column], cost: str, budget: int = BUDGET, limit: int = LIMIT) -> DataFrame:
    """RET-09, TK-06: greedy choice per group: always the first; one that would exceed the budget is passed over; until `limit`.

    The rule sees the whole group. Once a row is passed over, so are all later ones of its cost, and at most `limit` are
    taken, so the first `limit` rows of each cost (of all costs beyond the budget together) decide, and the fold is bounded.
    """
    from pyspark.sql import Window

    of_cost = Window.partitionBy(*by, F.least(F.col(cost), F.lit(budget + 1))).orderBy(*order)
    top = ranked.withColumn("__at", F.row_number().over(of_cost)).where(F.col("__at") <= limit)
    top = top.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("__at", F.col(cost).cast("long").alias("cost"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc, x):
        take = (F.size(acc["kept"]) < limit) & ((F.size(acc["kept"]) == 0) | (acc["used"] + x["cost"] <= budget))
        return F.when(take, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["kept"], F.array(x["__at"])).alias("kept"))).otherwise(acc)

    kept = top.groupBy(*by).agg(F.aggregate(rows, start, step)["kept"].alias("kept")).select(*by, F.explode("kept").alias("__at"))
    return top.join(kept, [*by, "__at"]).drop("__at")


def stored_ids(hits: DataFrame, persisted: DataFrame) -> DataFrame:
    """JN-04: hits with the message_id of the stored line they stand for, null where there is none: by id, or else by content, sender
    (case aside) and time; of lines that agree, the greatest message_id. Both: id, content, sender, timestamp; persisted: message_id."""
    low = F.lower("sender")
    by_id = persisted.groupBy("id").agg(F.max("message_id").alias("by_id"))
    by_text = persisted.groupBy(F.col("content").alias("c2"), low.alias("k2"), F.col("timestamp").alias("t2")).agg(F.max("message_id").alias("by_text"))
    own = hits.withColumn("ks", low)
    placed = own.join(by_id, "id", "left").join(by_text, own["content"].eqNullSafe(by_text["c2"]) & (own["ks"] == by_text["k2"]) & own["timestamp"].eqNullSafe(by_text["t2"]), "left")
    return placed.withColumn("message_id", F.coalesce("by_id", "by_text")).drop("by_id", "by_text", "ks", "c2", "k2", "t2")


def polarity(rows: DataFrame, text: str, by: list[str], where: Column | None = None) -> DataFrame:
    """RET-11: per group whether some text tells a preference against, and some one for; both is a contradiction."""
    on = F.lit(True) if where is None else where
    neg, pos = F.col(text).rlike(NEGATIVE_PREFERENCE), F.col(text).rlike(PREFERENCE)
    any_ = lambda c: F.coalesce(F.max(on & c), F.lit(False))
    return rows.groupBy(*by).agg(any_(neg).alias("against"), any_(pos & ~neg).alias("for_it"))


def evidence(hits: DataFrame, persisted: DataFrame, question: str, participant: str, limit: int = LIMIT, budget: int = BUDGET) -> DataFrame:
    """RET-08, JN-04, RET-09: the evidence for a question about one participant.

    hits: id, content, sender, timestamp, distance. persisted: id, message_id, content, sender, timestamp of stored
    lines (of lines that agree, the last message_id counts). A hit must be the participant's and stored, by id or else by content,
    sender and time. Eligible are those that share a topic term, if there is any, and tell a preference, if one is asked for.
    """
    who = participant.lower()
    mine = persisted.where(F.lower("sender") == who)
    verified = stored_ids(hits.where(F.lower("sender") == who), mine).where("message_id is not null")
    scored = score(verified, question, participant, budget)
    prefers = asks_preference(question)
    eligible = scored.where((F.col("asked") == 0) | (F.col("overlap") > 0))
    if prefers:
        eligible = eligible.where("prefers")
    order = [F.desc("score"), F.desc("overlap"), F.asc("message_id")]
    chosen = select_within(eligible.withColumn("__q", F.lit(1)), ["__q"], order, "cost", budget, limit) if "cost" in eligible.columns else select_within(eligible.withColumns({"__q": F.lit(1), "cost": F.length("excerpt")}), ["__q"], order, "cost", budget, limit)
    return chosen.select("message_id", "sender", "timestamp", "excerpt", F.round("score", 4).alias("score"), "overlap")


def merged(corrections: DataFrame, evidence_: DataFrame, limit: int = LIMIT, budget: int = BUDGET) -> DataFrame:
    """RET-13: corrections before other evidence, each message_id once, under one budget and limit.

    corrections: message_id, excerpt, score in order of their column `place`; evidence_: message_id, excerpt, score, overlap.
    Columns: message_id, excerpt, score, overlap, place (0 from the front).
    """
    first = corrections.select("message_id", "excerpt", "score", F.lit(0).cast("int").alias("overlap"), F.struct(F.lit(0).alias("part"), (-F.col("place").cast("double")).alias("score"), F.lit(0).alias("overlap"), F.lit("").alias("id")).alias("at"))
    rest = evidence_.select("message_id", "excerpt", "score", F.col("overlap").cast("int").alias("overlap"), F.struct(F.lit(1).alias("part"), F.col("score"), F.col("overlap").cast("int").alias("overlap"), F.col("message_id").alias("id")).alias("at"))
    both = first.unionByName(rest)
    order = [F.asc("at.part"), F.desc("at.score"), F.desc("at.overlap"), F.asc("at.id")]
    once = both.groupBy("message_id").agg(F.min_by(F.struct("excerpt", "score", "overlap", "at"), F.struct("at.part", -F.col("at.score"))).alias("r")).select("message_id", "r.*").withColumns({"__q": F.lit(1), "cost": F.length("excerpt")})
    chosen = select_within(once, ["__q"], order, "cost", budget, limit)
    from pyspark.sql import Window

    return chosen.select("message_id", "excerpt", "score", "overlap", (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))


def enrichment(profile: DataFrame, edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """RET-14: (slug, name, identity_type, message_count, first_seen, last_seen, relationship_types, wiki_pages) of each profile.

    profile: as `profiles.profiles` gives, with slug; edges: slug, subject, object, type; pages: slug, page. Pages belong to personas;
    those whose name begins with an underscore are no content.
    """
    ends = edges.select("slug", F.col("subject").alias("name"), "type").unionByName(edges.select("slug", F.col("object").alias("name"), "type")).where("type != ''")
    types = ends.groupBy("slug", "name").agg(F.array_sort(F.collect_set("type")).alias("relationship_types"))
    none = F.array().cast("array<string>")
    out = profile.join(types, ["slug", "name"], "left")
    if pages is not None:
        out = out.join(pages.where(~F.col("page").startswith("_")).groupBy("slug").agg(F.array_sort(F.collect_set("page")).alias("all_pages")), "slug", "left")
    shown = F.when(F.col("identity_type") == "persona", F.coalesce("all_pages", none)).otherwise(none) if pages is not None else none
    return out.select("slug", "name", *SAFE[:4], F.coalesce("relationship_types", none).alias("relationship_types"), shown.alias("wiki_pages"))


# What of an archive, besides evidence, may reach whoever words the answer.
SAFE = ("identity_type", "message_count", "first_seen", "last_seen", "relationship_types", "wiki_pages")


def safe_context(context: dict) -> dict:
    """PRJ-07: the part of a context that may be passed on."""
    return {k: context[k] for k in SAFE if k in context}


@dataclass(frozen=True)
class Worded:
    """RET-16: what a provider gives back: a text with `[message_id]` markers, what it cites, how sure it is, or that it abstains."""

    text: str
    citations: list[str]
    confidence: float = 0.0
    abstained: bool = False


#: RET-16: called with question, participant, evidence (rows as dicts, in order), the safe context and the language.
Provider = Callable[[str, str, list[dict], dict, str], Worded]


class GroundingError(ValueError):
    """An answer that cites nothing, or what is no evidence, or does not mark what it cites."""


def quote(question: str, participant: str, evidence_: list[dict], context: dict, language_: str) -> Worded:
    """RET-15: the provider used where none is given: a lead and at most three quotes."""
    rows = evidence_[:3]
    lead = f"Lo que consta de {participant}:" if language_ == "es" else f"What {participant} said:"
    text = "\n".join([lead, *[f"- {r['excerpt']} [{r['message_id']}]" for r in rows]])
    return Worded(text, [r["message_id"] for r in rows], sum(r["score"] for r in rows) / len(rows))


def gates(evidence_: DataFrame, question: str, participant: str) -> DataFrame:
    """RET-10, RET-11: one row: supported, contradictory, for the evidence of a question."""
    q = topic_terms(question, participant)
    asks, over = asks_preference(question), term_overlap(q, F.col("excerpt"))
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    g = evidence_.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"), any_((over > 0) if q else F.lit(True)).alias("on_topic"), any_(F.col("excerpt").rlike(PREFERENCE)).alias("prefers"))
    supported = (F.col("best") >= SUPPORT) & F.col("on_topic") & (F.col("prefers") if asks else F.lit(True))
    return g.crossJoin(polarity(evidence_, "excerpt", [], over > 0)).select(supported.alias("supported"), (F.col("against") & F.col("for_it") & F.lit(asks and bool(q))).alias("contradictory"))


def answer(evidence_: DataFrame, question: str, participant: str, provider: Provider = quote, context: dict | None = None) -> dict:
    """RET-15..19: a grounded answer, or an abstention with its reason. At most `limit` rows come to the driver.

    evidence_: message_id, excerpt, score, overlap, and place, if an order is given; else by score, overlap and message_id.
    """
    gate = gates(evidence_, question, participant).first()
    spoken = "es" if "¿" in question or set(re.findall(r"\w+", question.lower())) & set(SPANISH_MARKERS) else "en"

    def abstain(reason: str) -> dict:
        text = f"No hay pruebas suficientes para responder sobre {participant}." if spoken == "es" else f"There is not enough evidence to answer about {participant}."
        return {"text": text, "citations": [], "confidence": 0.0, "abstained": True, "reason": reason}

    if gate["contradictory"]:
        return abstain("contradictory_evidence")
    if not gate["supported"]:
        return abstain("insufficient_relevant_evidence")
    order = [F.asc("place")] if "place" in evidence_.columns else [F.desc("score"), F.desc("overlap"), F.asc("message_id")]
    rows = [r.asDict() for r in evidence_.orderBy(*order).collect()]
    said = provider(question, participant, rows, safe_context(context or {}), spoken)
    if said.abstained:
        return abstain("provider_abstained")
    if not valid_citations(said.text, said.citations, {r["message_id"] for r in rows}):
        raise GroundingError(f"cited {said.citations or 'nothing'}, of {[r['message_id'] for r in rows]}")
    return {"text": said.text, "citations": list(dict.fromkeys(said.citations)), "confidence": round(min(max(said.confidence, 0.0), 1.0), 4), "abstained": False, "reason": None}


def valid_citations(text: str, citations: list[str], evidence_ids: set[str]) -> bool:
    """RET-17: there are citations, all from the evidence, and each stands in the text."""
    return bool(citations) and set(citations) <= evidence_ids and all(f"[{c}]" in text for c in citations)
