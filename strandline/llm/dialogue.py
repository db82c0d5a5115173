"""Problem 4: message rows become ordered conversations with roles; files that yield none are dropped with the reason.

Method: each turn's parent is the turn before it in its file. The rows are range-partitioned by file and instant and
sorted, which contracts every run of turns inside a block to one segment; the segments' parent pointers are resolved
by iterative pointer jumping (`paths.resolve`), which gives each segment its place in the conversation and what was
said before it. A file may span any number of blocks, so none has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import clean_role, says_something
from strandline.functions.timestamps import instant, usable_zone
from strandline.llm import paths
from strandline.operators.instants import newest_sources
from strandline.session import durable, lookup

ROLES = ("user", "assistant")


def _code(role: Column, said: Column) -> Column:
    """1 a user row that says something, 2 an assistant row that does, 0 any other row that does, -1 one that does not."""
    return F.when(~said, F.lit(-1)).when(role == "user", F.lit(1)).when(role == "assistant", F.lit(2)).otherwise(F.lit(0)).cast("int")


def turns(message: DataFrame, sources: DataFrame, content: bool = False) -> DataFrame:
    """(seq, source_file, line_no, at_us, code[, role, content]) of every row that has a source_file.

    at_us is null for a stamp without a real instant. See _code for code.
    """
    keep = ["role", "content"] if content else []
    role, said = clean_role(F.col("role")), says_something(F.col("content"))
    rows = message.where("source_file is not null").select("seq", "source_file", "line_no", F.col("timestamp").alias("stamp"), F.lower("source_type").alias("kind"), _code(role, said).alias("code"), *([role.alias("role"), "content"] if content else []))
    placed = lookup(rows, sources, ["source_file"], "seq", ["time_zone", "locale"])
    slash = F.coalesce(F.col("locale") == "en-US", F.lit(False))
    us = instant(F.col("stamp"), usable_zone(F.coalesce("time_zone", F.lit("UTC"))), slash, F.coalesce(F.col("kind") == "imessage", F.lit(False)))
    return placed.select("seq", "source_file", "line_no", us.alias("at_us"), "code", *keep)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows with `block` and `rank`, both rising in the order of (source_file, instant with null first, line_no, seq)."""
    order = [F.col("source_file"), F.col("at_us").asc_nulls_first(), F.col("line_no"), F.col("seq")]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranked.withColumn("rank", F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id())


def segments(ranked: DataFrame) -> DataFrame:
    """One row per file and block: its rows, and what is said in it. Pre-aggregated where the rows are."""
    user, reply = F.col("code") == 1, F.col("code") == 2
    return ranked.groupBy("source_file", "block").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.col("code") >= 0).alias("says"),
        F.min(F.when(user, F.col("rank"))).alias("first_user"),
        F.max(F.when(reply, F.col("rank"))).alias("last_reply"),
        F.min("rank").alias("first_rank"),
    )


def resolved(segs: DataFrame) -> DataFrame:
    """Segments with before_rows and before_users: rows, and segments with a user's words, earlier in the file."""
    # The parent is the same file's segment one block earlier; a file has no more segments than there are blocks.
    earlier = F.lag("block").over(Window.partitionBy("source_file").orderBy("block"))
    nodes = segs.withColumn("earlier", earlier).select(
        F.struct("source_file", "block").alias("id"), F.when(F.col("earlier").isNotNull(), F.struct("source_file", F.col("earlier").alias("block"))).alias("parent"), "rows", F.col("first_user").isNotNull().cast("long").alias("users")
    )
    # Files inside one block are roots without children; only those that span blocks need to jump.
    spanning = durable(segs.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "p4-spanning")
    jumping = nodes.join(spanning.select(F.col("source_file").alias("f")), F.col("id.source_file") == F.col("f"), "left_semi")
    placed = paths.resolve(durable(jumping, "p4-nodes"), ["rows", "users"], "p4-paths").select("id.source_file", "id.block", "before_rows", "before_users", "state")
    joined = segs.join(placed, ["source_file", "block"], "left")
    return joined.withColumn("before_rows", F.coalesce("before_rows", F.lit(0))).withColumn("before_users", F.coalesce("before_users", F.lit(0)))


def verdicts(ranked: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, segments): per source_file its reason (null: kept), and the resolved segments."""
    segs = durable(resolved(durable(segments(ranked), "p4-segments")), "p4-resolved")
    replied = F.col("last_reply").isNotNull() & ((F.col("before_users") > 0) | (F.col("first_user") < F.col("last_reply")))
    said = segs.groupBy("source_file").agg(F.max("says").alias("says"), F.max(F.coalesce(replied, F.lit(False))).alias("replied"))
    lines = ranked.groupBy("source_file").agg(F.countDistinct("line_no").alias("seen"))
    files = said.join(lines, "source_file").join(sources.select("source_file", "lines"), "source_file", "left")
    reason = F.when(~F.col("says"), "empty").when(F.col("seen") < F.col("lines"), "broken").when(~F.col("replied"), "no_reply")
    return files.select("source_file", reason.alias("reason")), segs


def found(message: DataFrame, source_index: DataFrame) -> DataFrame:
    """(source_file, reason) of the dropped files: `empty`, else `broken`, else `no_reply`.

    A file that source_index lacks, or has without lines, cannot be broken. Files without rows do not appear.
    """
    sources = durable(newest_sources(source_index), "p4-sources")
    ranked = durable(blocks(durable(turns(message, sources), "p4-turns")), "p4-ranked")
    return verdicts(ranked, sources)[0].where("reason is not null")


def conversations(message: DataFrame, source_index: DataFrame) -> DataFrame:
    """(source_file, turn_no, role, content, at_us, line_no, seq, thread_line, thread_depth, thread_state) of the kept files.

    Turns are the rows of user and assistant that say something, each line once (its smallest seq); turn_no counts
    the file's rows from 0 in order, so it rises but may skip rows that are no turns. thread_*: the line that the turn's
    chain of replies starts from, how many replies lie between, and whether the chain is sound (see `threads`).
    """
    sources = durable(newest_sources(source_index), "p4-sources")
    ranked = durable(blocks(durable(turns(message, sources, content=True), "p4-turns")), "p4-ranked")
    files, segs = verdicts(ranked, sources)
    kept = files.where("reason is null").select("source_file")
    placed = ranked.where("code in (1, 2)").join(segs.join(kept, "source_file", "left_semi").select("source_file", "block", "before_rows", "first_rank"), ["source_file", "block"])
    once = placed.groupBy("source_file", "line_no").agg(F.min(F.struct("seq", "rank", "block", "before_rows", "first_rank", "role", "content", "at_us")).alias("r")).select("source_file", "line_no", "r.*")
    replies = threads(message).select("source_file", "line_no", F.col("root_line").alias("thread_line"), F.col("depth").alias("thread_depth"), F.col("state").alias("thread_state"))
    numbered = once.select("source_file", (F.col("before_rows") + F.col("rank") - F.col("first_rank")).alias("turn_no"), "role", "content", "at_us", "line_no", "seq")
    return numbered.join(replies, ["source_file", "line_no"], "left").select(*numbered.columns, "thread_line", "thread_depth", "thread_state")


def reply_nodes(message: DataFrame) -> DataFrame:
    """(id, parent): each line of a file once (the row with the smallest seq), and the line its metadata.reply_to names."""
    reply = F.get_json_object("metadata", "$.reply_to").try_cast("int")
    rows = message.where("source_file is not null and line_no is not null").groupBy("source_file", "line_no").agg(F.min(F.struct("seq", reply.alias("reply"))).alias("m"))
    return rows.select(F.struct("source_file", F.col("line_no").cast("int").alias("line_no")).alias("id"), F.when(F.col("m.reply").isNotNull(), F.struct("source_file", F.col("m.reply").alias("line_no"))).alias("parent"))


def threads(message: DataFrame) -> DataFrame:
    """(source_file, line_no, root_line, depth, state): reply chains by metadata.reply_to within each file.

    A row without reply_to is a root; `orphan` answers a line the file lacks (root_line), by `depth` lines between; `cycle` answers
    itself by some way and has neither root nor depth.
    Lines delivered more than once count once, with the smallest seq. Metadata that is no JSON has no reply_to.
    """
    out = paths.resolve(durable(reply_nodes(message), "p4-replies"), [], "p4-threads")
    depth = F.when(F.col("state") != "cycle", F.col("depth"))
    return out.select("id.source_file", "id.line_no", F.col("root.line_no").alias("root_line"), depth.alias("depth"), "state")


def reply_paths(message: DataFrame) -> DataFrame:
    """(source_file, leaf_line, place, line_no): every sound chain of replies from its root (place 0) to its leaf.

    A leaf is a line that answers another and that no line answers; lines outside any chain, orphans and cycles give no path.
    """
    nodes = durable(reply_nodes(message), "p4-replies")
    out = paths.root_to_leaf(nodes, paths.resolve(nodes, [], "p4-threads"), "p4-leaf-paths")
    return out.select("leaf.source_file", F.col("leaf.line_no").alias("leaf_line"), "place", "id.line_no")
