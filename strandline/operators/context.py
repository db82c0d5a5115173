"""Manual context: sources, blocks, kinds, subjects, previews (SRC-25, GV-08..10, JN-13, AG-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import collapse, content_hash

# Prefixes of a block, by kind, confidence and authority.
KINDS = {
    ("assertion", 1.0, "user_assertion"): "assert assertion fact hecho afirmacion",
    ("freeform", 0.75, "user_context"): "context contexto note nota",
    ("inference", 0.5, "user_inference"): "inference inferencia",
}
PREFIXES = {w: v for v, words in KINDS.items() for w in words.split()}
#: Letters with accents and those without, for keys of names.
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")


def plain_key(c: Column) -> Column:
    """Without case, accents of Latin letters, and runs of white space."""
    return collapse(F.translate(F.lower(c), *ACCENTS))


def blocks(text: Column) -> Column:
    """The blocks of a text between blank lines, white space collapsed."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.filter(F.transform(F.split(unix, r"(?U)\n\s*\n"), collapse), lambda b: b != "")


def classify(df: DataFrame, text: str) -> DataFrame:
    """GV-08: df with kind, confidence, authority and body by the block's prefix; without a known one it is freeform.

    A block with nothing after its prefix has a null body: there it is an error.
    """
    form = r"(?sU)^([\w]+)\s*:\s*(.*)$"
    prefix = F.translate(F.lower(F.regexp_extract(text, form, 1)), *ACCENTS)
    table = F.create_map(*[x for w, (k, c, a) in PREFIXES.items() for x in (F.lit(w), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(a).alias("authority")))])
    hit = F.element_at(table, prefix)
    return df.withColumns({
        "kind": F.coalesce(hit["kind"], F.lit("freeform")), "confidence": F.coalesce(hit["confidence"], F.lit(0.75)), "authority": F.coalesce(hit["authority"], F.lit("user_context")),
        "body": F.when(hit.isNotNull(), F.nullif(F.trim(F.regexp_extract(text, form, 2)), F.lit(""))).otherwise(F.col(text)),
    })


def mentions(blocks_: DataFrame, names: DataFrame, row_id: str, text: str, by: list[str]) -> DataFrame:
    """(by, row_id, name): the participants that a block names, by any alias, as whole words.

    names: by, name, alias. An alias meets only the blocks that hold its first word, by an equi-join. Neither side is broadcast:
    a block is as many rows with its text as it has words, and Spark's estimate of a size counts it once.
    """
    words = blocks_.select(*by, row_id, plain_key(F.col(text)).alias("t")).withColumn("first", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?U)(\w+)"), F.lit(1)))))
    a = names.select(*by, "name", plain_key(F.col("alias")).alias("alias")).where(F.length("alias") >= 2).withColumn("first", F.regexp_extract("alias", r"(?U)^\W*(\w+)", 1))
    padded = F.concat(F.lit(" "), F.regexp_replace("t", r"(?U)[^\w]+", " "), F.lit(" "))
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace("alias", r"(?U)[^\w]+", " ")), F.lit(" "))
    return words.join(a.hint("merge"), [*by, "first"]).where(F.contains(padded, spaced)).select(*by, row_id, "name").distinct()


def subjects(blocks_: DataFrame, names: DataFrame, row_id: str, text: str, by: list[str], forced: str | None = None) -> DataFrame:
    """GV-09: (by, row_id, subject, named): the one participant a block names, or the forced one; null where it names none or several."""
    if forced:
        return blocks_.select(*by, row_id, F.lit(forced).alias("subject"), F.lit(None).cast("long").alias("named"))
    m = mentions(blocks_, names, row_id, text, by).groupBy(*by, row_id).agg(F.count(F.lit(1)).alias("named"), F.min("name").alias("one"))
    return blocks_.select(*by, row_id).join(m, [*by, row_id], "left").select(*by, row_id, F.when(F.col("named") == 1, F.col("one")).alias("subject"), F.coalesce("named", F.lit(0)).alias("named"))


# The largest source of manual context, in bytes.
MOST_BYTES = 10 * 1024 * 1024


class ContextError(ValueError):
    """A source of manual context that cannot be taken, or a block of it."""


def refusals(files: DataFrame) -> DataFrame:
    """SRC-25: (path, refused): why a file (path, content as bytes) is no source of context: `too large`, `not UTF-8`, `binary`,
    `empty`; null where it is one."""
    text = F.expr("try_validate_utf8(cast(content as string))")
    return files.select("path", F.when(F.length("content") > MOST_BYTES, "too large").when(text.isNull(), "not UTF-8").when(F.contains(text, F.lit("\x00")), "binary").when(F.size(blocks(text)) == 0, "empty").alias("refused"))


def preview(blocks_: DataFrame, names: DataFrame, known: DataFrame, by: list[str], forced: str | None = None) -> DataFrame:
    """GV-10: what a context source would add, without writing: (by, number, kind, confidence, authority, subject, content, hash,
    duplicate, problem).

    blocks_: by, number, block; names: by, name, alias; known: hash of stored messages. duplicate: stored already, or an earlier
    block is the same. problem: `empty` block, `no participant`, `several participants`; a source with any is not applied.
    """
    c = classify(blocks_, "block").withColumn("content", F.col("body")).drop("body")
    s = subjects(c.withColumn("text", F.coalesce("content", F.lit(""))), names, "number", "text", by, forced)
    j = c.join(s, [*by, "number"], "left")
    h = content_hash(F.lit("user"), F.col("content"), source_type=F.lit("user_context"), subject=F.col("subject"), kind=F.col("kind"), authority=F.col("authority"))
    j = j.withColumn("hash", h).withColumn("problem", F.when(F.col("content").isNull(), "empty").when(F.col("subject").isNull() & (F.coalesce("named", F.lit(0)) == 0), "no participant").when(F.col("subject").isNull(), "several participants"))
    first = j.groupBy(*by, "hash").agg(F.min("number").alias("first"))
    stored = known.select("hash").distinct().withColumn("stored", F.lit(True))
    out = j.join(first, [*by, "hash"], "left").join(stored, "hash", "left")
    return out.select(*by, "number", "kind", "confidence", "authority", "subject", "content", "hash", (F.coalesce("stored", F.lit(False)) | (F.col("first") < F.col("number"))).alias("duplicate"), "problem")


def kind_counts(preview_: DataFrame, by: list[str]) -> DataFrame:
    """AG-18: blocks to be stored per group and kind, duplicates left out."""
    return preview_.where("not duplicate and problem is null").groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("records"))


def messages(preview_: DataFrame, source: str) -> DataFrame:
    """GV-10: the messages that a sound preview stores."""
    meta = F.create_map(F.lit("authored_by"), F.lit("dataset_owner"), F.lit("record_kind"), F.col("kind"), F.lit("authority"), F.col("authority"), F.lit("confidence"), F.col("confidence").cast("string"))
    rows = preview_.where("not duplicate and problem is null")
    return rows.select(F.col("number").cast("int").alias("line_no"), F.lit("user").alias("role"), "content", F.lit(None).cast("string").alias("timestamp"), F.lit(source).alias("source_file"), F.lit("user_context").alias("source_type"), F.col("subject").alias("sender"), meta.alias("metadata"), "hash")
