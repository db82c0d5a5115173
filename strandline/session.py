"""Sessions, table loading and durable intermediate tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", app: str = "strandline", partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A local session for tests, the bench and the command line; on a cluster the caller brings its own.

    scratch: the folder for intermediate tables; by default `shared_dir` takes one of this machine, as a local session may.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scratch:
        builder = builder.config(CHECKPOINT_CONF, scratch if "://" in scratch else f"file://{os.path.abspath(scratch)}")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSharedFolder(RuntimeError):
    """A cluster session without spark.checkpoint.dir: executors could not read each other's intermediate tables."""


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder all executors share, as spark.checkpoint.dir names it.

    Only a local session, where driver and executors are one process, may do without that setting: it gets a temporary
    folder of this machine. Anywhere else its absence is an error.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise NoSharedFolder(f"set {CHECKPOINT_CONF} to a folder that all executors of {master} share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"strandline-{os.getpid()}")
    return f"{found.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_count(df: DataFrame, label: str, flag: str) -> tuple[DataFrame, int]:
    """`durable`, and how many of the rows written have the flag: counted as they are written, without another job."""
    seen = Observation()
    out = durable(df.observe(seen, F.sum(F.col(flag).cast("long")).alias("n")), label)
    return out, seen.get["n"] or 0


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs of a long iteration left in the driver: plans, broadcasts, generated classes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key is hot if it holds this share of all rows, or this many rows, whichever is less; never under 1/MOST_HOT or 1,000.
HOT_SHARE, HOT_ROWS, MOST_HOT = 1 / 256, 4_000_000, 200_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than `share` of the rows, or more than `rows` of them: MOST_HOT at most, so the result may be broadcast.

    The count is pre-aggregated before its shuffle. Columns: keys, n.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    least = F.greatest(F.least(F.col("__total") * share, F.lit(rows)), F.col("__total") / MOST_HOT, F.lit(1000))
    return counts.join(F.broadcast(total), F.col("n") > least).drop("__total")


#: Rows of a lookup table with one narrow row per key that are broadcast; `small` counts them first.
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether a table has at most `most` rows; no more than that many and one are read."""
    return df.limit(most + 1).count() <= most


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], row_id: str, values: list[str], salts: int = 1024) -> DataFrame:
    """Left join to a table with one row per key, safe where a key (or null) holds a large share of `rows`.

    Lookup rows of hot keys (see hot_keys) are broadcast; their rows, and rows with a null key, are
    spread over salts, so that no task gets them all. Every row keeps its place exactly once.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hot = hot_keys(rows.where(known), keys).select(*keys)
    spread = F.broadcast(lookup.join(F.broadcast(hot), keys, "left_semi").select(*keys, *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__is_hot")))
    r = rows.join(spread, keys, "left")
    apart = F.col("__is_hot").isNotNull() | ~known
    r = r.withColumn("__salt", F.when(apart, 1 + F.pmod(F.xxhash64(row_id), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    cold = lookup.select(*keys, *values).withColumn("__salt", F.lit(0))
    j = r.join(cold, [*keys, "__salt"], "left")
    return j.select(*rows.columns, *[F.when(F.col("__is_hot"), F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def lookup(rows: DataFrame, table_: DataFrame, keys: list[str], row_id: str, values: list[str]) -> DataFrame:
    """Left join to a table with one row per key: by broadcast where a count shows that it has few rows, else `lookup_join`."""
    if small(table_):
        return rows.join(F.broadcast(table_.select(*keys, *values)), keys, "left").select(*rows.columns, *values)
    return lookup_join(rows, table_, keys, row_id, values)


def lookup_pairs(rows: DataFrame, others: DataFrame, key: str, spread: Column, salts: int = 64) -> DataFrame:
    """Inner join on `key`, safe where a key holds a large share of `rows`: those of hot keys (see hot_keys) are spread over
    `salts` by `spread`, and what `others` holds of them is repeated as often; all other keys join as they are."""
    hot = hot_keys(rows.where(F.col(key).isNotNull()), [key]).select(key, F.lit(True).alias("__hot"))
    hot = durable(hot, "hot-keys")
    r = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    o = others.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return r.join(o, [key, "__salt"]).drop("__salt")
