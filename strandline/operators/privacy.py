"""Personal data by fixed patterns: counts, redaction, policy (AG-04, AG-05, GV-05..07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import PII, pii_counts, pii_redact


def scan(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """AG-05: matches per kind and group, with a row for the whole (groups null)."""
    counted = df.select(*by, *[c.alias(k) for k, c in pii_counts(F.coalesce(F.col(text), F.lit(""))).items()])
    return counted.rollup(*by).agg(*[F.sum(k).alias(k) for k in PII])


def redact(df: DataFrame, text: str) -> DataFrame:
    """GV-06: df with the text redacted, kind after kind."""
    return df.withColumn(text, pii_redact(F.col(text)))


def gate(df: DataFrame, text: str, by: list[str], policy: str = "block") -> DataFrame:
    """GV-07: per group `allow` or, where anything matches, what the policy says (block or redact)."""
    total = sum(pii_counts(F.coalesce(F.col(text), F.lit(""))).values())
    hit = df.groupBy(*by).agg(F.sum(total).alias("matches"))
    return hit.withColumn("decision", F.when((F.col("matches") > 0) & (F.lit(policy) != "allow"), policy).otherwise("allow"))
