"""Problem 6: stamps of mixed notation, precision and zone become one instant each.

Method: a dictionary of the distinct (stamp, zone, order, epoch) strings is parsed once and may be kept and extended
between runs; the parsed instants are joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.timestamps import instant, usable_zone
from strandline.session import durable, hot_keys, lookup, shared_dir

KEY = ["stamp", "zone", "month_first", "apple"]
#: Rows that hold one key are spread over so many salts where the key is hot.
SALTS = 1024


def newest_sources(source_index: DataFrame) -> DataFrame:
    """One row per filename, that of the newest imported_at (ties: most lines, then the greatest zone and locale).

    Columns: source_file, lines, time_zone, locale. Rows without filename are left out.
    """
    row = F.struct("imported_at", "lines", "time_zone", "locale")
    newest = source_index.where("filename is not null").groupBy(F.col("filename").alias("source_file")).agg(F.max(row).alias("r"))
    return newest.select("source_file", "r.lines", "r.time_zone", "r.locale")


def stamp_rows(rows: DataFrame, sources: DataFrame, row_id: str) -> DataFrame:
    """(row_id, stamp, zone, month_first, apple) of each row with a stamp, once per row_id.

    The zone matters only where the stamp carries none; elsewhere it is left out of the key, so that the same stamp
    in files of different zones is parsed once. A file that source_index lacks is read as UTC, day first.
    """
    s = rows.select(F.col(row_id).alias("row_id"), "source_file", F.col("timestamp").alias("stamp"), F.lower("source_type").alias("kind")).where("stamp is not null and row_id is not null")
    joined = lookup(s, sources, ["source_file"], "row_id", ["time_zone", "locale"])
    bare = F.col("stamp").rlike(r"^[\s\p{Z}]*\d+[\s\p{Z}]*$")
    fixed = bare | F.col("stamp").rlike(r"(?i)(:.*[+-]\d{2}:?\d{2}|t\d{6}.*[+-]\d{2}:?\d{2}|\dz|[a-z]{3,4})[\s\p{Z}]*$") & ~F.col("stamp").rlike(r"(?i)m\.?[\s\p{Z}\]]*$") | F.col("stamp").rlike(r" [+-]\d{4} \d{4}[\s\p{Z}]*$")
    slashed = F.col("stamp").rlike(r"^\W*\d{1,2}[/-]\d")
    return joined.select(
        "row_id",
        "stamp",
        F.when(fixed, F.lit("UTC")).otherwise(F.coalesce("time_zone", F.lit("UTC"))).alias("zone"),
        (slashed & F.coalesce(F.col("locale") == "en-US", F.lit(False))).alias("month_first"),
        (bare & F.coalesce(F.col("kind") == "imessage", F.lit(False))).alias("apple"),
    )


def parse(keys: DataFrame) -> DataFrame:
    """keys with utc_us: null where the stamp names no real instant."""
    return keys.withColumn("utc_us", instant(F.col("stamp"), usable_zone(F.col("zone")), F.col("month_first"), F.col("apple")))


def extend_dictionary(stamps: DataFrame, path: str) -> DataFrame:
    """Parse the keys that the dictionary table at `path` lacks, append them, and return the whole dictionary.

    One writer at a time: two that extend it at once may both add a key.
    """
    spark = stamps.sparkSession
    keys = stamps.select(*KEY).distinct()
    schema = parse(keys.limit(0)).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        keys = keys.join(spark.read.schema(schema).parquet(path).select(*KEY), KEY, "left_anti")
    parse(keys).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def normalise(stamps: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """Join each stamp row to its parsed instant. Columns of `stamps` and utc_us (null: no real instant).

    A stamp that holds a large share of all rows is joined by broadcast (at most 256 such keys can exist), so no task
    gets all of its rows; all others are joined by a shuffle. With `dictionary_path`, the dictionary is kept there
    and only strings that are new are parsed.
    """
    dictionary = extend_dictionary(stamps, dictionary_path) if dictionary_path else parse(stamps.select(*KEY).distinct())
    hot = parse(hot_keys(stamps, KEY).select(*KEY)).select(*KEY, F.col("utc_us").alias("hot_us"), F.lit(True).alias("is_hot"))
    rows = stamps.join(F.broadcast(hot), KEY, "left")
    rows = rows.withColumn("salt", F.when(F.col("is_hot"), 1 + F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    cold = dictionary.withColumn("salt", F.lit(0))
    joined = rows.join(cold, [*KEY, "salt"], "left")
    return joined.select("row_id", *KEY, F.when(F.col("is_hot"), F.col("hot_us")).otherwise(F.col("utc_us")).alias("utc_us"))


def kept_dictionary(spark: SparkSession) -> str:
    """Where the queries keep their dictionary: in the shared folder, from one run of an application to the next."""
    return f"{shared_dir(spark)}/p6-dictionary"


def found(message: DataFrame, evidence: DataFrame, source_index: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """(tbl, row_id, utc_us): every stamp of message and evidence that names a real instant, once per row_id.

    Null stamps, stamps without a real instant and rows without id are left out; empty tables give no rows. Of rows
    that repeat one id with several stamps, the earliest instant counts.
    """
    sources = durable(newest_sources(source_index), "p6-sources")
    m = stamp_rows(message, sources, "seq")
    e = stamp_rows(evidence.select("evidence_no", "source_file", "timestamp", "source_type").distinct(), sources, "evidence_no")
    both = m.withColumn("tbl", F.lit("message")).unionByName(e.withColumn("tbl", F.lit("evidence")))
    tagged = both.withColumn("row_id", F.struct("tbl", "row_id")).drop("tbl")
    us = normalise(tagged, dictionary_path).where("utc_us is not null")
    return us.groupBy("row_id").agg(F.min("utc_us").alias("utc_us")).select("row_id.tbl", "row_id.row_id", "utc_us")
