"""Runs and neighbours in ordered groups of any size.

A window over a group puts all of it into one task. Here rows are range-partitioned by group and order, windows run
inside (group, block), and what crosses a block border is carried over by a table with one row per group and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import durable


def ranked(df: DataFrame, keys: list[str], order: list[Column], label: str = "ranked") -> DataFrame:
    """df with `__rank`, rising in (keys, order), and `__block`; written once, so that both stay what they are."""
    by = [F.col(k) for k in keys] + order
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return durable(placed.withColumn("__rank", F.monotonically_increasing_id()).withColumn("__block", F.spark_partition_id()), label)


def runs(df: DataFrame, keys: list[str], order: list[Column], of: str, label: str = "runs") -> DataFrame:
    """df with `__rank` and `run`: the rank of the first row of the run of equal values of column `of` that a row is in."""
    r = ranked(df, keys, order, label)
    block = Window.partitionBy(*keys, "__block").orderBy("__rank")
    r = r.withColumn("__before", F.lag(of).over(block)).withColumn("__inner", F.lag("__rank").over(block).isNotNull())
    last = r.groupBy(*keys, "__block").agg(F.max_by(of, "__rank").alias("__last"))
    # One row per group and block; a group has no more blocks than there are partitions.
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block"))).select(*keys, "__block", "__carried")
    r = r.join(carried, [*keys, "__block"])
    before = F.when(F.col("__inner"), F.col("__before")).otherwise(F.col("__carried"))
    r = r.withColumn("__start", F.when(~F.col(of).eqNullSafe(before), F.col("__rank")))
    inside = r.withColumn("run", F.last("__start", ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, 0)))
    starts = r.groupBy(*keys, "__block").agg(F.max("__start").alias("__s"))
    open_run = starts.withColumn("__open", F.max("__s").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "__block", "__open")
    out = inside.join(open_run, [*keys, "__block"])
    return out.withColumn("run", F.coalesce("run", "__open")).drop("__before", "__inner", "__carried", "__start", "__open", "__block")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order` (which must be unique within the key), whole.

    The first places are found by a pre-aggregated minimum; the rows follow by a semi join, so a key that holds a
    third of all rows costs its task one number per input partition.
    """
    order = [o for o in order if o not in keys]
    place = F.struct(*order)
    first = df.groupBy(*keys).agg(F.min(place).alias("__p")).select(*keys, *[F.col(f"__p.{o}").alias(o) for o in order])
    cond = None
    for c in [*keys, *order]:
        eq = df[c].eqNullSafe(first[c])
        cond = eq if cond is None else cond & eq
    return df.join(first, cond, "left_semi")
