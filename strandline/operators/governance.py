"""Layers that must agree, and what is kept apart (GV-03, GV-04, GV-11, GV-12, GV-14, GV-17, SNK-02, SNK-04, SNK-05, SNK-10, JN-10, JN-15, ST-01..04, AG-15, AG-19, TK-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered import first_rows


def vector_difference(expected: DataFrame, stored: DataFrame, metadata: list[str]) -> DataFrame:
    """SNK-04, JN-10: (id, state): missing, stale, changed or same, for the ids of either table."""
    e = expected.select("id", F.struct(*metadata).alias("e"), F.lit(True).alias("in_e"))
    s = stored.select("id", F.struct(*metadata).alias("s"), F.lit(True).alias("in_s"))
    j = e.join(s, "id", "full_outer")
    return j.select("id", F.when(F.col("in_s").isNull(), "missing").when(F.col("in_e").isNull(), "stale").when(~F.col("e").eqNullSafe(F.col("s")), "changed").otherwise("same").alias("state"))


def prune(stored: DataFrame, authoritative: DataFrame) -> DataFrame:
    """SNK-05: stored rows whose id is still wanted."""
    return stored.join(authoritative.select("id").distinct(), "id", "left_semi")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-02: new rows over old ones of the same id."""
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new)


def invariants(unique_messages: DataFrame, profiles: DataFrame, vectors: DataFrame, declared: int | None = None) -> DataFrame:
    """GV-11, AG-19: (layer, count, agrees): the layers' totals against the unique messages."""
    layers = unique_messages.agg(F.count(F.lit(1)).alias("count")).withColumn("layer", F.lit("messages"))
    layers = layers.unionByName(profiles.agg(F.coalesce(F.sum("message_count"), F.lit(0)).cast("long").alias("count")).withColumn("layer", F.lit("profiles")))
    layers = layers.unionByName(vectors.agg(F.count(F.lit(1)).alias("count")).withColumn("layer", F.lit("vectors")))
    if declared is not None:
        layers = layers.unionByName(layers.limit(1).select(F.lit(declared).cast("long").alias("count"), F.lit("declared").alias("layer")))
    truth = unique_messages.agg(F.count(F.lit(1)).alias("truth"))
    return layers.crossJoin(F.broadcast(truth)).select("layer", "count", (F.col("count") == F.col("truth")).alias("agrees"))


def diagnosis(checks: DataFrame) -> DataFrame:
    """GV-12: one row: error where a layer disagrees, warning where one is empty, healthy otherwise. checks: layer, count, agrees."""
    worst = checks.agg(F.max(~F.col("agrees")).alias("bad"), F.max(F.col("count") == 0).alias("none"))
    return worst.select(F.when(F.col("bad"), "error").when(F.col("none"), "warning").otherwise("healthy").alias("status"))


def quarantine(index: DataFrame, names: DataFrame, reason: str) -> DataFrame:
    """GV-14, SNK-14: the source index with a status: quarantined (and why) for the named files, active for the rest. Nothing is moved or lost."""
    q = names.select(F.col("filename")).distinct().withColumn("__q", F.lit(True))
    return index.join(q, "filename", "left").withColumns({"status": F.when(F.col("__q"), "quarantined").otherwise("active"), "reason": F.when(F.col("__q"), reason)}).drop("__q")


def restore(index: DataFrame, names: DataFrame, earlier: DataFrame) -> DataFrame:
    """GV-14, JN-15: index entries of the restored names: as they were, or made up with null figures where no earlier index has them."""
    back = names.select("filename").distinct().join(earlier, "filename", "left")
    return index.join(back.select("filename"), "filename", "left_anti").unionByName(back, allowMissingColumns=True)


def imported_before(index: DataFrame, sources: DataFrame) -> DataFrame:
    """GV-17: those of `sources` (source) that the index names."""
    return sources.join(index.select("source").distinct(), "source", "left_semi")


def identity_types(profiles: DataFrame) -> DataFrame:
    """AG-15: participants by identity type."""
    return profiles.groupBy("identity_type").agg(F.count(F.lit(1)).alias("participants"))


def latest_export(exports: DataFrame, version: str | None = None, digest: str | None = None) -> DataFrame:
    """TK-05: the export of that version and digest if there is one, else the newest. exports: version, digest, modified."""
    match = F.coalesce((F.col("version") == version) & (F.col("digest") == digest), F.lit(False)) if version and digest else F.lit(False)
    return exports.orderBy(F.desc(match), F.desc("modified"), F.desc("version")).limit(1)


def statistics(messages: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """SNK-10: per group sources, total_messages, assistant_turns, kg_entities, kg_relationships, counted anew."""
    m = messages.groupBy(*by).agg(F.count_distinct("source_file").alias("sources"), F.count(F.lit(1)).alias("total_messages"), F.sum((F.col("role") == "assistant").cast("long")).alias("assistant_turns"))
    ends = edges.select(*by, F.lower("subject").alias("e")).unionByName(edges.select(*by, F.lower("object").alias("e"))).groupBy(*by).agg(F.count_distinct("e").alias("kg_entities"))
    n = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("kg_relationships"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return m.join(ends, by, "left").join(n, by, "left").select(*by, "sources", "total_messages", zero("assistant_turns"), zero("kg_entities"), zero("kg_relationships"))


def replaced(messages: DataFrame, new: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GV-03: (kept, brought): stored messages without those of the equivalent `sources` (source_file), and the new ones that the
    kept ones lack, first occurrences. Both sides carry `hash`."""
    kept = messages.join(sources.select("source_file").distinct(), "source_file", "left_anti")
    return kept, first_rows(new.join(kept.select("hash").distinct(), "hash", "left_anti"), ["hash"], ["source_file", "line_no"])


def keep_one(messages: DataFrame, by: list[str], keep: DataFrame) -> DataFrame:
    """GV-04: per group the source that stays, how many sources are set aside, and how many different messages are left.

    messages: by, source_file, hash; keep: by, kept.
    """
    m = messages.join(keep, by)
    own = F.col("source_file") == F.col("kept")
    return m.groupBy(*by, "kept").agg(F.count_distinct(F.when(~own, F.col("source_file"))).alias("set_aside"), F.count_distinct(F.when(own, F.col("hash"))).alias("messages"))
