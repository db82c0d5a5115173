"""Ingest: boundaries, keys, first occurrences, new rows, equivalent sources, vector records (PRJ-01..06, GV-01, GV-02, JN-02, JN-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import content_hash, hall, label_role, strip, vector_id
from strandline.operators.ordered import first_rows
from strandline.sources.readers import is_notice

# When two sources count as one.
LEAST_MESSAGES, LEAST_COVERAGE, LEAST_SIZE_RATIO = 20, 0.95, 0.90


def normalise_roles(df: DataFrame, persona: str = "") -> DataFrame:
    """PRJ-02: role as user or assistant; null or no label is the assistant's."""
    return df.withColumn("role", label_role(F.coalesce("role", F.lit("")), persona))


def reject_senders(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-04: (kept, rejected) rows; a sender with a line break, of over 100 characters, or that is a notice is none."""
    s = F.coalesce("sender", F.lit(""))
    bad = s.rlike(r"[\r\n]") | (F.length(s) > 100) | is_notice(s)
    return df.where(~bad), df.where(bad)


def hashed(df: DataFrame) -> DataFrame:
    """df with `hash`, the identity of a message: its role and content (and more for manual context, where columns tell)."""
    has = set(df.columns)
    extra = {k: F.col(c) for k, c in (("source_type", "source_type"), ("subject", "sender"), ("kind", "record_kind"), ("authority", "authority")) if c in has}
    qualified = extra if {"source_type", "subject", "kind", "authority"} <= set(extra) else {}
    return df.withColumn("hash", content_hash(F.col("role"), F.col("content"), **qualified))


def deduplicate(df: DataFrame, order: list[str]) -> DataFrame:
    """GV-01: the first occurrence of each hash. Equal content by two senders is one message, as identities go here."""
    return first_rows(df, ["hash"], order)


def only_new(df: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """JN-02: first occurrences whose hash `existing` lacks."""
    return deduplicate(df.join(existing.select("hash").distinct(), "hash", "left_anti"), order)


def equivalent_sources(fingerprints: DataFrame, least: int = LEAST_MESSAGES, coverage: float = LEAST_COVERAGE, ratio: float = LEAST_SIZE_RATIO) -> DataFrame:
    """GV-02, JN-03: pairs of sources that share a fingerprint, with multiset overlap and whether they count as one.

    fingerprints: source, fp (null ones are left out). Columns: a, b, overlap, size_a, size_b, coverage, equivalent.
    Small sources (under `least` in the smaller) must agree entirely. Fingerprints meet as counts per source, so a
    text repeated often in one source joins once.
    """
    counts = fingerprints.where("fp is not null").groupBy("source", "fp").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("source").agg(F.sum("c").alias("size"))
    x, y = counts.select(F.col("source").alias("a"), "fp", F.col("c").alias("ca")), counts.select(F.col("source").alias("b"), "fp", F.col("c").alias("cb"))
    shared = x.join(y, "fp").where("a < b").groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("overlap"))
    sized = shared.join(sizes.select(F.col("source").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("source").alias("b"), F.col("size").alias("size_b")), "b")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    cov = F.col("overlap") / small
    same = F.when(small < least, (F.col("overlap") == small) & (small == large)).otherwise((cov >= coverage) & (small / large >= ratio))
    return sized.select("a", "b", "overlap", "size_a", "size_b", cov.alias("coverage"), same.alias("equivalent"))


def vector_records(df: DataFrame) -> DataFrame:
    """PRJ-06: id, document and flat metadata of each hashed message; empty optional fields are null."""
    blank = lambda c: F.nullif(strip(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    return df.select(
        vector_id(F.col("slug"), F.col("hash")).alias("id"), F.col("content").alias("document"), F.col("slug").alias("wing"), F.lit("messages").alias("room"), hall(F.col("source_type")).alias("hall"), "role", "source_file", "source_type", blank("sender").alias("sender"), blank("timestamp").alias("authored_at"),
    )


def multiset_intersection(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """ST-02: rows that both tables hold, each as often as in the one that holds it less often."""
    return a.select(*columns).intersectAll(b.select(*columns))
