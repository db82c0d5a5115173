"""Problem 3: a feed of corrections and undos is replayed to the claims that stand at the end.

Method: per-key ordered replay. The deliveries are taken once per event, range-partitioned by (slug, claim, instant,
line) and sorted, and a state machine runs over each block, applying partial-column updates. A key that spans blocks
(a hot claim, a block border) leaves one state per block; states are merged in order, which is associative, so no key
has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import clean_role
from strandline.functions.timestamps import instant, usable_zone

#: Content columns a correction may set; one left null keeps what an earlier correction set.
CONTENT = ["retract_subject", "retract_predicate", "retract_object", "assert_subject", "assert_predicate", "assert_object", "confidence", "raw_text", "authority", "authored_by"]
ORDER = ["at_us", "ledger_line"]


def applicable(ledger: DataFrame) -> DataFrame:
    """The deliveries to apply, each event once: (slug, claim, kind, at_us, ledger_line, event_id, content columns).

    Left out: rows without event_id or created_at, with a created_at that is no instant, of another type than
    correction and undo, without the claim they name. Of an event's deliveries the smallest ledger_line counts (equal
    lines: the earliest instant). kind is `set` or `drop`.
    """
    # Undos name the claim itself or its assert or retract part.
    claim = F.when(F.col("kind") == "drop", F.regexp_replace("target_claim_id", r":(assert|retract)$", "")).otherwise(F.col("claim_id"))
    rows = (
        ledger.withColumn("kind", F.when(clean_role(F.col("event_type")) == "correction", "set").when(clean_role(F.col("event_type")) == "undo", "drop"))
        .withColumn("at_us", instant(F.col("created_at"), usable_zone(F.lit("UTC")), F.lit(False), F.lit(False)))
        .withColumn("claim", claim)
        .where("event_id is not null and kind is not null and at_us is not null and claim is not null and ledger_line is not null")
        .select("slug", "claim", "kind", "at_us", "ledger_line", "event_id", *CONTENT)
    )
    # An event's repeats meet in a pre-aggregated minimum that carries the whole row, so stamps are parsed once, and
    # deliveries of one line that differ give the smallest of them.
    row = [*ORDER[::-1], "slug", "claim", "kind", *CONTENT]
    first = rows.groupBy("event_id").agg(F.min(F.struct(*row)).alias("f"))
    return first.select("f.slug", "f.claim", "f.kind", "f.at_us", "f.ledger_line", "event_id", *[f"f.{c}" for c in CONTENT])


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Run the state machine over sorted rows; one state per key and batch.

    A state holds the last drop (dropped_us, dropped_line) and, per content column, the last set after that drop with
    its place, plus the last set at all. The columns are replayed with whole-array operations.
    """
    for pdf in batches:
        if pdf.empty:
            continue
        key = pdf.groupby(["slug", "claim"], sort=False, dropna=False).ngroup()
        place = pd.Series(range(len(pdf)))
        pdf = pdf.reset_index(drop=True)
        drop = place.where(pdf["kind"].eq("drop")).groupby(key.values).transform("max").fillna(-1)
        live = pdf["kind"].eq("set") & (place > drop)
        tail = pdf.groupby(key.values, sort=False).tail(1).index
        out = pdf.loc[tail, ["slug", "claim"]].copy()
        codes = key.values[tail]
        by_key = lambda mask: place.where(mask).groupby(key.values).max().reindex(codes).values
        dropped = by_key(pdf["kind"].eq("drop"))

        def at(where, column):
            known = ~pd.isna(where)
            values = pd.Series([None] * len(where), dtype=object)
            values[known] = pdf[column].values[where[known].astype(int)]
            return values.values

        out["dropped_us"], out["dropped_line"] = at(dropped, "at_us"), at(dropped, "ledger_line")
        for column in ["event_id", *CONTENT]:
            last = by_key(live & pdf[column].notna())
            out[f"{column}_us"], out[f"{column}_line"], out[column] = at(last, "at_us"), at(last, "ledger_line"), at(last, column)
        yield out


def _state_schema(schema: T.StructType) -> T.StructType:
    fields = [T.StructField("slug", T.StringType()), T.StructField("claim", T.StringType()), T.StructField("dropped_us", T.LongType()), T.StructField("dropped_line", T.LongType())]
    for column in ["event_id", *CONTENT]:
        fields += [T.StructField(f"{column}_us", T.LongType()), T.StructField(f"{column}_line", T.LongType()), T.StructField(column, schema[column].dataType)]
    return T.StructType(fields)


def replay(events: DataFrame) -> DataFrame:
    """The claims that stand after all events of `applicable`: (slug, claim_id, event_id, at_us, ledger_line, content columns).

    event_id is that of the last correction. A claim without a correction after its last undo does not stand; an undo
    of a claim that does not stand has no effect. Ties in the instant are settled by ledger_line.
    """
    blocks = events.repartitionByRange("slug", "claim", *ORDER).sortWithinPartitions("slug", "claim", *ORDER)
    states = blocks.mapInPandas(_states, _state_schema(events.schema))
    place = lambda c: F.struct(F.col(f"{c}_us").alias("us"), F.col(f"{c}_line").alias("line"))
    last = lambda c: F.max(F.when(F.col(f"{c}_line").isNotNull(), F.struct(place(c).alias("p"), F.col(c).alias("v")))).alias(c)
    merged = states.groupBy("slug", "claim").agg(
        F.max(F.when(F.col("dropped_line").isNotNull(), place("dropped"))).alias("dropped"), *[last(c) for c in ["event_id", *CONTENT]]
    )
    live = lambda c: F.when(F.col("dropped").isNull() | (F.col(f"{c}.p") > F.col("dropped")), F.col(f"{c}.v"))
    standing = merged.where(F.col("event_id").isNotNull() & (F.col("dropped").isNull() | (F.col("event_id.p") > F.col("dropped"))))
    return standing.select(
        "slug", F.col("claim").alias("claim_id"), F.col("event_id.v").alias("event_id"), F.col("event_id.p.us").alias("at_us"), F.col("event_id.p.line").alias("ledger_line"), *[live(c).alias(c) for c in CONTENT]
    )


def found(ledger: DataFrame) -> DataFrame:
    """(claim_id, event_id): each standing claim and the correction that set its content last."""
    return replay(applicable(ledger)).select("claim_id", "event_id")
