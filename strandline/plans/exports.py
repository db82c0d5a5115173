"""Queries of the readers: messages are written in the form of an export into the shared folder and read again; the same rows in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.messages import collapse
from strandline.functions.text import MEDIA_MARKERS
from strandline.plans.core import _flat, _role
from strandline.session import shared_dir, table
from strandline.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Messages of one exported file: readers of whole files hold one at a time.
PER_FILE = 2000
PERSONA = "ana"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def said(spark, d) -> DataFrame:
    """(seq, sender, content, role): messages with a plain sender and text on one line, which any export can hold."""
    m = table(spark, d, "message").select("seq", collapse(F.col("sender")).alias("sender"), collapse(F.col("content")).alias("content"), "role")
    plain = (F.col("sender") != "") & ~F.contains("sender", F.lit(":")) & ~readers.is_notice(F.col("sender")) & (F.col("content") != "") & ~F.lower("content").isin(*MEDIA_MARKERS)
    return m.where(plain)


_MARKERS = ", ".join(f"'{m}'" for m in MEDIA_MARKERS)
_SAID = f"m AS (SELECT seq, {_flat('sender')} AS sender, {_flat('content')} AS content, role FROM message), s AS (SELECT * FROM m WHERE sender != '' AND NOT contains(sender, ':') AND content != '' AND lower(content) NOT IN ({_MARKERS}))"
_PERSONA_ROLE = f"CASE WHEN contains(lower(sender), '{PERSONA}') THEN 'assistant' ELSE 'user' END"


def files(rows: DataFrame, text: Callable[[Column], Column], label: str, below: str = "") -> str:
    """Write rows as files of some PER_FILE messages each; text makes a file of its sorted array of rows. Gives the folder."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    n = rows.count() // PER_FILE + 1
    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64("seq"), F.lit(n))).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rows.columns if c != "seq"]))).alias("m"))
    grouped.select("bucket", text(F.col("m")).alias("value")).write.partitionBy("bucket").text(f"{root}{below}")
    return root


def joined(m: Column, line: Callable[[Column], Column], by: str = "\n") -> Column:
    return F.array_join(F.transform(m, line), by)


def whatsapp_line(x: Column) -> Column:
    at = lambda a, b: (F.pmod(x["seq"], F.lit(a)) + b).cast("string")
    return F.concat(at(15, 13), F.lit("/"), at(12, 1), F.lit("/24, "), at(24, 0), F.lit(":"), F.lpad(at(60, 0), 2, "0"), F.lit(" - "), x["sender"], F.lit(": "), x["content"])


@query(f"WITH {_SAID} SELECT sender, content, {_PERSONA_ROLE} AS role, printf('2024-%02d-%02dT%02d:%02d:00', seq % 12 + 1, seq % 15 + 13, seq % 24, seq % 60) AS timestamp FROM s")
def q_read_whatsapp(spark, d):
    return readers.whatsapp(spark, files(said(spark, d), lambda m: joined(m, whatsapp_line), "whatsapp"), PERSONA).select("sender", "content", "role", "timestamp")


@query(f"WITH {_SAID} SELECT count(*) FILTER (seq % 3 = 0) AS rejected FROM s")
def q_whatsapp_rejected(spark, d):
    """Every third message is made a notice, or has no sender."""
    notice = lambda x: F.when(F.pmod(x["seq"], F.lit(3)) == 0, F.concat(F.lit("13/1/24, 10:00 - "), F.when(F.pmod(x["seq"], F.lit(2)) == 0, "Messages and calls are end-to-end encrypted: nobody").otherwise("someone joined"))).otherwise(whatsapp_line(x))
    return readers.whatsapp_rejected(spark, files(said(spark, d), lambda m: joined(m, notice), "notices")).agg(F.sum("rejected").alias("rejected"))


@query(f"WITH {_SAID} SELECT sender, content, {_PERSONA_ROLE} AS role FROM s")
def q_read_telegram(spark, d):
    half = lambda x: F.floor(F.length(x["content"]) / 2).cast("int")
    bold = lambda x: F.to_json(F.struct(F.lit("bold").alias("type"), F.substring(x["content"], half(x) + 1, F.length(x["content"])).alias("text")))
    string = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")
    one = lambda x: F.concat(F.lit('{"from":'), string(x["sender"]), F.lit(',"text":['), string(F.substring(x["content"], F.lit(1), half(x))), F.lit(","), bold(x), F.lit("]}"))
    path = files(said(spark, d), lambda m: F.concat(F.lit('{"chats":{"list":[{"name":"c","messages":['), joined(m, one, ","), F.lit("]}]}}")), "telegram")
    return readers.telegram(spark, path, PERSONA).select("sender", "content", "role")


@query(f"WITH {_SAID} SELECT sender, content, {_PERSONA_ROLE} AS role, strftime(make_timestamp(CAST(1700000000 + seq AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS timestamp FROM s")
def q_read_signal(spark, d):
    one = lambda x: F.struct(x["sender"].alias("sender"), x["content"].alias("body"), ((F.lit(1700000000).cast("long") + x["seq"]) * F.when(F.pmod(x["seq"], F.lit(2)) == 0, 1000).otherwise(1)).alias("timestamp"))
    path = files(said(spark, d), lambda m: F.to_json(F.transform(m, one)), "signal")
    return readers.signal(spark, path, PERSONA).select("sender", "content", "role", "timestamp")


@query(f"WITH {_SAID} SELECT content, {_role('role')} AS role FROM s WHERE seq % 7 != 0")
def q_read_jsonl(spark, d):
    """Every seventh line is cut short, and skipped."""
    root = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("role", F.col("content").alias("text")))
    said(spark, d).select(F.when(F.pmod("seq", F.lit(7)) == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(root)
    return readers.jsonl(spark, root).select("content", "role")


@query(f"WITH {_SAID}, f AS (SELECT count(*) AS n FROM s) SELECT n AS lines, CAST(1 AS BIGINT) AS least, true AS dense FROM f")
def q_jsonl_lines(spark, d):
    """Lines of a file are counted from 1 without a gap, whatever the splits it is read in."""
    root = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    said(spark, d).select(F.to_json(F.struct("role", F.col("content").alias("text"))).alias("value")).coalesce(1).write.text(root)
    kept = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(kept)
    spark.conf.set(kept, str(64 * 1024))
    try:
        r = readers.jsonl(spark, root)
        return spark.createDataFrame([tuple(r.agg(F.count(F.lit(1)), F.min("line_no").cast("long"), (F.countDistinct("line_no") == F.max("line_no") - F.min("line_no") + 1)).first())], "lines long, least long, dense boolean")
    finally:
        spark.conf.set(kept, before)


@query(f"WITH {_SAID} SELECT content, {_PERSONA_ROLE} AS role FROM s")
def q_read_csv(spark, d):
    root = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    said(spark, d).select(F.col("sender").alias("Author"), F.col("content").alias("Message")).write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(root)
    return readers.csv(spark, root, PERSONA).select("content", "role")


@query(f"WITH {_SAID} SELECT content, CAST(seq AS VARCHAR) AS memory_id FROM s")
def q_read_memories(spark, d):
    one = lambda x: F.struct(x["seq"].cast("string").alias("id"), x["content"].alias("memory"))
    path = files(said(spark, d), lambda m: F.concat(F.lit('{"memories":'), F.to_json(F.transform(m, one)), F.lit("}")), "memories")
    return readers.json_file(spark, path, entity="e").select("content", F.col("metadata")["memory_id"].alias("memory_id"))


@query(f"WITH {_SAID} SELECT content FROM s WHERE length(content) >= 20")
def q_read_text(spark, d):
    return readers.plain_text(spark, files(said(spark, d), lambda m: joined(m, lambda x: x["content"], "\n\n"), "text")).select("content")


@query(f"WITH {_SAID} SELECT content, seq % 2 = 0 AS is_reply FROM s WHERE seq % 5 != 0 AND NOT starts_with(content, 'RT @')")
def q_read_tweets(spark, d):
    """Every fifth is a retweet, every other one a reply; links are shortened ones."""
    text = lambda x: F.concat(F.when(F.pmod(x["seq"], F.lit(5)) == 0, "RT @x ").otherwise(""), x["content"], F.lit(" https://t.co/abc"))
    one = lambda x: F.struct(F.struct(text(x).alias("full_text"), x["seq"].cast("string").alias("id_str"), F.when(F.pmod(x["seq"], F.lit(2)) == 0, "x").alias("in_reply_to_screen_name"), F.lit("Wed Oct 10 20:19:24 +0000 2018").alias("created_at")).alias("tweet"))
    root = files(said(spark, d), lambda m: F.concat(F.lit("window.YTD.tweets.part0 = "), F.to_json(F.transform(m, one))), "tweets", "/data/tweets.js")
    return readers.twitter(spark, root).select("content", (F.col("metadata")["is_reply"] == "true").alias("is_reply"))


@query(f"WITH {_SAID} SELECT content, CAST(seq AS VARCHAR) AS sender_id FROM s")
def q_read_tweet_messages(spark, d):
    one = lambda x: F.struct(F.struct(x["content"].alias("text"), x["seq"].cast("string").alias("senderId")).alias("messageCreate"))
    root = files(said(spark, d), lambda m: F.concat(F.lit('x = [{"dmConversation":{"messages":'), F.to_json(F.transform(m, one)), F.lit("}}]")), "dms", "/data/direct-messages.js")
    return readers.twitter_dms(spark, root).select("content", F.col("metadata")["sender_id"].alias("sender_id"))
