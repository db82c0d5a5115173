"""Dialogue exports (WN-02, WN-03, AG-12, AG-13, AG-16, WX-09, WX-12, WX-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.messages import strip
from strandline.operators.ordered import ranked, runs


def turns(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WN-02, WN-03: (keys, turn, role, content): neighbours of one role become one turn, from the first user turn to the last answer.

    Only rows of user and assistant that hold text count. turn counts from 0 in each group. Works on groups of any size
    (see operators.ordered); a single turn is one value, as long as what was said in one go.
    """
    said = messages.select(*keys, *[c for c in order if c not in (*keys, "role", "content")], F.col("role"), strip(F.col("content")).alias("content")).where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    r = runs(said, keys, [F.col(c) for c in order], "role", "turns")
    grouped = r.groupBy(*keys, "run").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "content"))), lambda x: x["content"]), "\n").alias("content"))
    ends = grouped.groupBy(*keys).agg(F.min(F.when(F.col("role") == "user", F.col("run"))).alias("first"), F.max(F.when(F.col("role") == "assistant", F.col("run"))).alias("last"))
    kept = grouped.join(ends, keys).where((F.col("run") >= F.col("first")) & (F.col("run") <= F.col("last"))).drop("first", "last")
    placed = ranked(kept, keys, [F.col("run")], "turn-numbers")
    # Ranks are consecutive inside a block only; earlier blocks of the group add their sizes.
    sizes = placed.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__rank").alias("__first"))
    earlier = sizes.withColumn("__earlier", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(earlier.select(*keys, "__block", "__first", "__earlier"), [*keys, "__block"])
    return out.select(*keys, (F.col("__rank") - F.col("__first") + F.col("__earlier")).cast("long").alias("turn"), "role", "content")


def quality(turns_: DataFrame) -> DataFrame:
    """AG-12: one row: turns by role, their ratio, mean lengths, different questions and topics asked about."""
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    topic = F.lower(strip(F.regexp_extract("content", r"(?iU)(?:about your |about )([\w\s-]+)", 1)))
    n = turns_.withColumn("topic", F.when(user, F.nullif(topic, F.lit("")))).agg(
        F.sum(reply.cast("long")).alias("assistant_turns"), F.sum(user.cast("long")).alias("user_turns"), F.avg(F.when(reply, F.length("content"))).alias("avg_assistant_len"), F.avg(F.when(user, F.length("content"))).alias("avg_user_len"),
        F.count_distinct(F.when(user, F.col("content"))).alias("unique_questions"), F.count_distinct("topic").alias("topic_count"),
    )
    return n.select(
        F.coalesce("assistant_turns", F.lit(0)).alias("assistant_turns"), F.coalesce("user_turns", F.lit(0)).alias("user_turns"), F.round(F.when(F.col("user_turns") > 0, F.col("assistant_turns") / F.col("user_turns")).otherwise(0.0), 6).alias("role_ratio"), F.round(F.coalesce("avg_assistant_len", F.lit(0.0)), 6).alias("avg_assistant_len"), F.round(F.coalesce("avg_user_len", F.lit(0.0)), 6).alias("avg_user_len"), "topic_count", "unique_questions",
    )


def word_totals(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """AG-13: words per group; null texts have none."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return df.groupBy(*by).agg(F.sum(n.cast("long")).alias("words"))


def source_statistics(messages: DataFrame) -> DataFrame:
    """AG-16: per source its lines, assistant rows, and a digest of its content that no order of rows changes: sha256 of the sorted line digests."""
    line = F.sha2(F.concat_ws("\x1f", F.col("line_no").cast("string"), F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))), 256)
    per = messages.withColumn("d", line)
    # The digests of one source are folded in two steps, 256 groups first, so that no task sorts them all.
    part = per.groupBy("source_file", F.substring("d", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == "assistant").cast("long")).alias("a"))
    return part.groupBy("source_file").agg(F.sum("n").alias("lines"), F.coalesce(F.sum("a"), F.lit(0)).alias("assistant_turns"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "d"))), ""), 256), 1, 16).alias("content_hash"))


def next_version(history: list[str]) -> str:
    """WX-12: v1, or the last version's number plus one; after a version without number, the count plus one."""
    if not history:
        return "v1"
    tail = history[-1].lstrip("v")
    return f"v{int(tail) + 1}" if tail.isdigit() else f"v{len(history) + 1}"


def file_snapshot(files: DataFrame) -> DataFrame:
    """WX-13: (path, digest) of a binaryFile table: the first 16 hex digits of each file's sha256."""
    return files.select("path", F.concat(F.lit("sha256:"), F.substring(F.sha2("content", 256), 1, 16)).alias("digest"))
