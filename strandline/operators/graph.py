"""The knowledge graph: edges, statistics, neighbourhood, paths, and the effective graph under corrections (KG-01..03, KG-08, KG-14..20, AG-06, AG-07, JN-05..08, JN-11, SRC-27, SRC-28, SNK-06..08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import claim_id, strip
from strandline.session import durable

# What tells of a romance.
ROMANTIC = r"(?iu)\b(?:mi\s+(?:novia|novio|pareja)|amor\s+de\s+mi\s+vida|quiero\s+todo\s+contigo)\b"
EDGE = ["subject", "object", "type", "confidence", "source", "timestamp"]


def membership(messages: DataFrame, order: str = "seq") -> DataFrame:
    """KG-01: sender participant_in slug, with source and time of the sender's first message."""
    s = messages.withColumn("key", F.lower(strip(F.col("sender")))).where("key != ''")
    first = s.groupBy("slug", "key").agg(F.min_by(F.struct(strip(F.col("sender")).alias("name"), "source_file", "timestamp"), order).alias("m"))
    return first.where(F.col("key") != F.lower("slug")).select("slug", F.col("m.name").alias("subject"), F.col("slug").alias("object"), F.lit("participant_in").alias("type"), F.lit(1.0).alias("confidence"), F.col("m.source_file").alias("source"), F.col("m.timestamp").alias("timestamp"))


def communication(messages: DataFrame, order: str = "seq") -> DataFrame:
    """KG-02: persona communicates_with contact, per archive; an equi-join of its personas (as a rule one) with its contacts."""
    s = messages.withColumn("key", F.lower(strip(F.col("sender")))).where("key != ''")
    names = s.groupBy("slug", "key").agg(
        F.min_by(strip(F.col("sender")), F.when(F.col("role") == "assistant", F.col(order))).alias("persona"), F.min_by(strip(F.col("sender")), F.when(F.coalesce(F.col("role") != "assistant", F.lit(True)), F.col(order))).alias("contact"), F.min_by(F.struct("source_file", "timestamp"), order).alias("m")
    )
    a = names.where("persona is not null").select("slug", F.col("key").alias("ka"), "persona")
    b = names.where("contact is not null").select("slug", F.col("key").alias("kb"), "contact", "m")
    return a.join(b, "slug").where("ka != kb").select("slug", F.col("persona").alias("subject"), F.col("contact").alias("object"), F.lit("communicates_with").alias("type"), F.lit(1.0).alias("confidence"), F.col("m.source_file").alias("source"), F.col("m.timestamp").alias("timestamp"))


def romance(messages: DataFrame, order: str = "seq") -> DataFrame:
    """KG-03: romantic_partner between the only persona and the only contact of an archive, where a message tells of one; the first is the evidence."""
    s = messages.withColumn("key", F.lower(strip(F.coalesce("sender", F.lit("")))))
    named = F.col("key") != ""
    persona, contact = named & (F.col("role") == "assistant"), named & F.coalesce(F.col("role") != "assistant", F.lit(True))
    g = s.groupBy("slug").agg(
        F.min(F.when(persona, F.col("key"))).alias("a"), F.max(F.when(persona, F.col("key"))).alias("a2"), F.min(F.when(contact, F.col("key"))).alias("b"), F.max(F.when(contact, F.col("key"))).alias("b2"),
        F.min_by(strip(F.col("sender")), F.when(persona, F.col(order))).alias("subject"), F.min_by(strip(F.col("sender")), F.when(contact, F.col(order))).alias("object"),
        F.min_by(F.struct("source_file", "timestamp"), F.when(F.col("content").rlike(ROMANTIC), F.col(order))).alias("m"),
    )
    only = g.where("a = a2 and b = b2 and a != b and m is not null")
    return only.select("slug", "subject", "object", F.lit("romantic_partner").alias("type"), F.lit(0.95).alias("confidence"), F.col("m.source_file").alias("source"), F.col("m.timestamp").alias("timestamp"))


def merge_edges(edges: DataFrame, by: list[str], order: str) -> DataFrame:
    """KG-08, AG-07: one edge per ends and type (without case), that of the greatest confidence, the first on ties. Loops are dropped."""
    keyed = edges.withColumns({"ks": F.lower(strip(F.col("subject"))), "ko": F.lower(strip(F.col("object")))}).where("ks != '' and ko != '' and ks != ko")
    rest = [c for c in edges.columns if c not in by and c != "type"]
    best = keyed.groupBy(*by, "ks", "ko", "type").agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col(order))).alias("e"))
    return best.select(*by, *[F.col(f"e.{c}").alias(c) for c in rest], "type")


def statistics(edges: DataFrame) -> DataFrame:
    """AG-06: (type, confidence, relationships): counts by type, by confidence, and of all, in one pass."""
    return edges.groupingSets([["type"], ["confidence"], []], "type", "confidence").agg(F.count(F.lit(1)).alias("relationships"))


def neighbourhood(edges: DataFrame, entity: str) -> DataFrame:
    """KG-14: edges from or to the entity."""
    return edges.where((F.col("subject") == entity) | (F.col("object") == entity))


def shortest_paths(edges: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """KG-17, KG-16: (node, hops, parent): nodes that the undirected graph reaches from `start`, in fewest hops; of equal parents the smallest.

    The frontier of each hop is joined to the edges and kept out of what was reached before, until it is empty, however
    many hops that takes, or holds `end`. What was reached is written anew every few hops, so no plan grows with their
    number; only whether the frontier is empty, or holds the end, comes to the driver.
    """
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).where("a != b").distinct()
    both = durable(both, "adjacency")
    first = edges.sparkSession.createDataFrame([(start, 0, None)], "node string, hops int, parent string").join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    reached = frontier = durable(first, "reached")
    hop = 0
    while True:
        hop += 1
        step = frontier.join(both, frontier["node"] == both["a"]).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = durable(step.join(reached.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "parent"), "frontier")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
        if end is not None and not frontier.where(F.col("node") == end).isEmpty():
            return reached
        if hop % 8 == 0:
            reached = durable(reached, "reached")


def path(edges: DataFrame, start: str, end: str) -> list[str] | None:
    """KG-19: the nodes from start to end, or None. As many rows come to the driver as the path has nodes."""
    reached = durable(shortest_paths(edges, start, end), "paths")
    node, out = end, []
    while node is not None:
        row = reached.where(F.col("node") == node).first()
        if row is None:
            return None
        out.append(node)
        node = row["parent"]
    return out[::-1]


def edge_between(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """KG-18: the first edge between two nodes, in either direction."""
    hit = edges.where(((F.col("subject") == a) & (F.col("object") == b)) | ((F.col("subject") == b) & (F.col("object") == a)))
    return hit.orderBy(order).limit(1)


def named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """SRC-27, JN-05: triples with names for ids; an id without entity stands for itself."""
    s = entities.select(F.col("id").alias("subject"), F.col("name").alias("sn"))
    o = entities.select(F.col("id").alias("object"), F.col("name").alias("on"))
    t = triples.join(s, "subject", "left").join(o, "object", "left")
    return t.withColumn("subject", F.coalesce("sn", "subject")).withColumn("object", F.coalesce("on", "object")).drop("sn", "on")


def orphans(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """JN-11: entities that no triple names; unlike NOT IN, nulls in the triples do no harm."""
    return entities.join(triples.select(F.col("subject").alias("id")), "id", "left_anti").join(triples.select(F.col("object").alias("id")), "id", "left_anti")


def unmanaged(triples: DataFrame, owner: str) -> DataFrame:
    """SNK-07: triples that other owners wrote, those without owner included."""
    return triples.where(~F.col("owner").eqNullSafe(owner))


def effective(base: DataFrame, corrections: DataFrame) -> DataFrame:
    """KG-15, JN-08: the graph under the active corrections, in order.

    base: subject, type, object and more; corrections: ord (from 1), claim_id, created_at and the retract_ and
    assert_ columns. The i-th correction drops edges that match what it retracts or asserts and adds its assertion.
    An edge of place p (base 0, the i-th assertion i) stands if no correction after p matches it; so per claim only the
    last correction that names it counts, which a pre-aggregated maximum gives, and one join decides each edge.
    """
    c = lambda p: claim_id(F.col(f"{p}_subject"), F.col(f"{p}_predicate"), F.col(f"{p}_object"))
    named_by = corrections.select("ord", c("retract").alias("claim")).unionByName(corrections.select("ord", c("assert").alias("claim")))
    last = named_by.groupBy("claim").agg(F.max("ord").alias("last"))
    old = base.select("subject", "type", "object", F.col("confidence").cast("double").alias("confidence"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("correction_id"))
    new = corrections.select(F.col("assert_subject").alias("subject"), F.col("assert_predicate").alias("type"), F.col("assert_object").alias("object"), F.lit(1.0).alias("confidence"), F.col("ord").cast("long").alias("ord"), F.col("claim_id").alias("correction_id"))
    edges = old.unionByName(new).withColumn("claim", claim_id(F.col("subject"), F.col("type"), F.col("object")))
    return edges.join(last, "claim", "left").where(F.col("last").isNull() | (F.col("last") <= F.col("ord"))).select(F.col("claim").alias("claim_id"), "subject", "type", "object", "confidence", "correction_id")


def ledger_status(corrections: DataFrame, undos: DataFrame) -> DataFrame:
    """KG-25, JN-09: each correction with status active or undone, and the undo (the last by `ord`).

    Undos of unknown claims are an error in a ledger that one writer kept; `unknown_undos` lists them.
    """
    u = undos.groupBy(F.col("target_claim_id").alias("claim_id")).agg(F.max_by("event_id", "ord").alias("undo_event_id"))
    return corrections.join(u, "claim_id", "left").withColumn("status", F.when(F.col("undo_event_id").isNull(), "active").otherwise("undone"))


def unknown_undos(corrections: DataFrame, undos: DataFrame) -> DataFrame:
    return undos.join(corrections.select(F.col("claim_id").alias("target_claim_id")).distinct(), "target_claim_id", "left_anti")


def fallback(edges: DataFrame, by: list[str]) -> DataFrame:
    """SRC-28: edges gathered once for each end or from a pending file: one per ends, type and time, the first `ord`, null times alike."""
    return edges.groupBy(*by, "subject", "object", "type", "timestamp").agg(F.min_by(F.struct("confidence", "source"), "ord").alias("r")).select(*by, "subject", "object", "type", "timestamp", "r.*")


def owned(edges: DataFrame, owner: str) -> DataFrame:
    """SNK-06: edges tagged with who wrote them."""
    return edges.withColumn("owner", F.lit(owner))


def profile_entities(profiles: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """JN-06: profiles with the entity of the same name, case aside, null where the graph has none; of several the smallest."""
    e = entities.withColumn("key", F.lower(strip(F.col("name")))).groupBy(*by, "key").agg(F.min("name").alias("entity"))
    return profiles.join(e, [*by, "key"], "left")


def invalid_entities(entities: DataFrame, triples: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """SNK-08: (by, id, name, reason): entities that no triple names and that are `malformed` (blank, of several lines, over 100
    characters) or a `shadow`: an alias of a participant, under whose own name it should stand. profiles: by, name, aliases."""
    lone = orphans(entities, triples)
    name = strip(F.coalesce("name", F.lit("")))
    bad = (name == "") | F.col("name").rlike(r"[\r\n]") | (F.length("name") > 100)
    alias = profiles.select(*by, "name", F.explode("aliases").alias("alias")).where(F.lower("alias") != F.lower("name")).select(*by, F.lower(strip(F.col("alias"))).alias("low")).distinct().withColumn("shadow", F.lit(True))
    j = lone.withColumn("low", F.lower(name)).join(alias, [*by, "low"], "left")
    return j.select(*by, "id", "name", F.when(bad, "malformed").when(F.col("shadow"), "shadow").alias("reason")).where("reason is not null")
