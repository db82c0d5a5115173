"""Participants: profiles, voice, activity, picks, name variants (AG-01, AG-02, AG-08..10, TK-03, KG-10)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.messages import strip


def profiles(messages: DataFrame, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """AG-01: one row per sender (without case): name as first seen, counts by role, first and last stamp as text, sources.

    messages: role, timestamp, source_file, sender and an order column. Rows without sender are left out.
    """
    keyed = messages.withColumn("key", F.lower(strip(F.col("sender")))).where("key != ''")
    count = lambda c: F.sum(c.cast("long"))
    return keyed.groupBy(*(by or []), "key").agg(
        F.min_by(strip(F.col("sender")), order).alias("name"),
        F.count(F.lit(1)).alias("message_count"),
        count(F.col("role") == "assistant").alias("assistant_messages"),
        count(F.coalesce(F.col("role") != "assistant", F.lit(True))).alias("user_messages"),
        F.min(F.nullif("timestamp", F.lit(""))).alias("first_seen"),
        F.max(F.nullif("timestamp", F.lit(""))).alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("sources"),
        F.when(count(F.col("role") == "assistant") > 0, "persona").otherwise("contact").alias("identity_type"),
    )


def monthly(messages: DataFrame, by: list[str]) -> DataFrame:
    """AG-09: messages per month, from stamps that begin with a year and month."""
    month = F.substring("timestamp", 1, 7)
    return messages.where(F.col("timestamp").rlike(r"^\d{4}-\d{2}")).groupBy(*by, month.alias("month")).agg(F.count(F.lit(1)).alias("messages"))


def voice(messages: DataFrame, by: list[str]) -> DataFrame:
    """AG-08: mean and exact median of words, questions, laughter and drawn-out letters per group; null contents are left out."""
    words = F.size(F.filter(F.split(F.col("content"), r"(?U)\s+"), lambda w: w != ""))
    n = lambda c: F.sum(c.cast("long"))
    return messages.where("content is not null").withColumn("w", words).groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"), F.round(F.avg("w"), 6).alias("mean_words"), F.median("w").alias("median_words"), n(F.contains("content", F.lit("?"))).alias("questions"), n(F.col("content").rlike("(?i)jaj+a")).alias("laughs"), n(F.col("content").rlike(r"(?iu)([a-záéíóúñ])\1{2,}")).alias("drawn_out")
    )


def pick(messages: DataFrame, patterns: dict[str, str], by: list[str], order: str, longest: bool = True) -> DataFrame:
    """TK-03, WX-03: per group and topic the order of the longest (or first) message that matches, the first on ties; else of the group's first.

    All topics in one pass and one pre-aggregated shuffle.
    """

    def best(p: str) -> Column:
        rank = F.struct(F.length("content").alias("n") if longest else F.lit(0).alias("n"), (-F.col(order)).alias("o"))
        return F.max(F.when(F.col("content").rlike(p), rank))["o"]

    return messages.where("content is not null").groupBy(*by).agg(*[F.coalesce(-best(p), F.min(order)).alias(t) for t, p in patterns.items()])


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """difflib's ratio of two strings."""
    return F.pandas_udf(_ratios, T.DoubleType())(a, b)


def name_variants(profiles_: DataFrame, messages: DataFrame, by: list[str]) -> DataFrame:
    """KG-10: words said at least twice that look like a contact's name: same beginning, no author, similar enough.

    Columns: by, key (of the contact), variant. Words are counted before they meet names, and meet them by their
    first three letters, which any shared beginning contains.
    """
    said = messages.select(*by, F.explode(F.regexp_extract_all("content", F.lit(r"(?U)\b([A-Za-zÁÉÍÓÚÑÜáéíóúñü]{3,})\b"), F.lit(1))).alias("variant"))
    counted = said.groupBy(*by, "variant").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("low", F.lower("variant"))
    authors = messages.select(*by, F.lower("sender").alias("low")).where("low is not null").distinct()
    counted = counted.join(authors, [*by, "low"], "left_anti").withColumn("start", F.substring("low", 1, 3))
    names = profiles_.where((F.col("identity_type") == "contact") & (F.length("key") >= 4)).select(*by, "key", F.substring("key", 1, 3).alias("start"))
    size = F.greatest(F.lit(3), F.least(F.lit(5), F.floor(F.length("key") / 2))).cast("int")
    near = counted.join(names, [*by, "start"]).where(F.col("low").startswith(F.substring(F.col("key"), F.lit(1), size)) & (F.col("low") != F.col("key")))
    return near.where(similarity(F.col("key"), F.col("low")) >= 0.45).select(*by, "key", "variant").distinct()


def preview(messages: DataFrame, existing: DataFrame, by: list[str]) -> DataFrame:
    """AG-02: per group and sender how many messages there are and how many are new. messages carry `hash`."""
    known = existing.select("hash").distinct().withColumn("known", F.lit(True))
    return messages.join(known, "hash", "left").groupBy(*by, "sender").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("known").isNull().cast("long")).alias("new_messages"))
