"""Problem 9: documents of several sources mixed so that the tokens per source meet target shares.

Method: capped water-filling. A source whose share would need more than its texts repeated max_repeat times is
clamped there, and what it lacks is spread over the others in proportion to their weights, until all are feasible.
Each source's texts are then repeated a whole number of times, and a seeded sample of them once more for the rest.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import durable

#: Buckets of the seeded order in which a source's texts are sampled.
BUCKETS = 65_536


def default_tokenizer() -> str:
    """The installed rank file of the multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_COUNTED = "doc_id long, source string, digest binary, tokens long"


def token_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, digest, tokens) of (doc_id, source, text), by a rank file that every executor can read.

    The digest stands for the text from here on: texts are read once and never moved.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for pdf in batches:
            tokens = [len(encoder.encode_ordinary(x)) for x in pdf["text"]]
            digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "digest": digests, "tokens": tokens})

    return texts.select("doc_id", "source", "text").mapInPandas(run, _COUNTED)


def water_fill(weights: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens per source: in proportion to the weights, none above its cap, budget in sum where the caps allow it."""
    given = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    left = min(budget, sum(caps.get(s, 0) for s in free))
    while free:
        scale = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * scale >= caps[s]}
        if not over:
            for s in free:
                given[s] = weights[s] * scale
            break
        for s in over:
            given[s] = float(caps[s])
            left -= caps[s]
        free -= over
        if left <= 0:
            break
    return given


def _sized(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens) of each different text of the sources in targets, under its smallest doc_id.

    Copies are found by digest, pre-aggregated, so that a text stored very often meets nowhere as a whole.
    """
    docs = documents.where("text is not null and text != '' and doc_id is not null").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    counted = token_counts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer)
    first = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("f"))
    return first.select("f.doc_id", "f.source", "f.tokens")


def _plan(spark: SparkSession, sized: DataFrame, targets: DataFrame, budget: int | None) -> DataFrame:
    """One row per source of targets: source, target_share, max_repeat, texts, tokens, given, repeats, rest.

    Only sums per source come to the driver, as many as targets has rows.
    """
    sums = {r["source"]: (r["texts"], r["tokens"]) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens")).collect()}
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat")).collect()
    total = sum(n for _, n in sums.values()) if budget is None else budget
    caps = {r["source"]: sums.get(r["source"], (0, 0))[1] * max(r["max_repeat"] or 0, 0) for r in rows}
    given = water_fill({r["source"]: max(r["target_share"] or 0.0, 0.0) for r in rows}, caps, total)
    out = []
    for r in rows:
        texts, tokens = sums.get(r["source"], (0, 0))
        whole = math.floor(given[r["source"]] / tokens + 1e-12) if tokens else 0
        rest = given[r["source"]] - whole * tokens if tokens else 0.0
        out.append((r["source"], r["target_share"], r["max_repeat"], texts, tokens, given[r["source"]], whole, max(rest, 0.0)))
    return spark.createDataFrame(out, "source string, target_share double, max_repeat int, texts long, tokens long, given double, repeats long, rest double")


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, budget: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: doc_id, source, tokens, copies, one row per text that is used; a text stored several times, in whichever
    sources, counts once, under its smallest doc_id. shares: one row per source of targets with texts, tokens,
    target_share, reached_share, epochs and max_repeat. budget is the size of the mixture in tokens, by default that
    of all different texts. Sources without texts give their weight to the others; documents of other sources or of
    none are left out; null or empty texts have no tokens.

    The fractional repetition takes texts in a seeded order until the rest is reached, to within half a text: sums
    per bucket of that order settle all buckets but one, and only the texts of that bucket are ordered.
    """
    spark = documents.sparkSession
    sized = durable(_sized(documents, targets, tokenizer or default_tokenizer()), "p9-sized")
    plan = _plan(spark, sized, targets, budget)
    place = sized.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = place.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("source", "bucket", F.coalesce("before", F.lit(0)).alias("before"), "in_bucket")
    cut = before.join(F.broadcast(plan.select("source", "rest")), "source").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bucket") >= F.col("rest")))
    cut = cut.select("source", F.col("bucket").alias("cut"), F.col("before").alias("cut_before"))
    rows = place.join(F.broadcast(plan.select("source", "repeats", "rest")), "source").join(F.broadcast(cut), "source", "left")
    # Without a cut the rest is 0 (none once more) or all that there is.
    edge = rows.where("bucket = cut").withColumn("mid", F.col("cut_before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "doc_id")) - F.col("tokens") / 2)
    settled = rows.where("cut is null or bucket != cut").withColumn("more", F.when(F.col("cut").isNotNull() & (F.col("bucket") < F.col("cut")), 1).otherwise(0))
    both = settled.select("doc_id", "source", "tokens", "repeats", "more").unionByName(edge.select("doc_id", "source", "tokens", "repeats", F.when(F.col("mid") <= F.col("rest"), 1).otherwise(0).alias("more")))
    used = both.select("doc_id", "source", "tokens", (F.col("repeats") + F.col("more")).cast("int").alias("copies")).where("copies > 0")
    used = durable(used, "p9-mixture")
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    whole = used.agg(F.sum(F.col("tokens") * F.col("copies")).alias("whole"))
    shares = plan.join(reached, "source", "left").crossJoin(F.broadcast(whole))
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    return used, shares.select(
        "source",
        "target_share",
        "max_repeat",
        "texts",
        "tokens",
        mixed.alias("mixed_tokens"),
        F.when(F.col("whole") > 0, mixed / F.col("whole")).otherwise(0.0).alias("reached_share"),
        F.when(F.col("tokens") > 0, mixed / F.col("tokens")).otherwise(0.0).alias("epochs"),
        (F.col("given") >= F.col("tokens") * F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0))).alias("clamped"),
    )
