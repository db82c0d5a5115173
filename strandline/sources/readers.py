"""Readers of message archives into one message table.

Columns of every reader: line_no, role, content, timestamp, source_file, source_type, sender, metadata (string map).
Timestamps are kept as ISO text in local or UTC time, as the source has them; the p6 operator gives instants.
A file is parsed where it is read, by built-in expressions; lines of one file keep their order by line_no.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.messages import collapse, epoch_iso, iso, label_role, persona_role, strip
from strandline.functions.text import MEDIA_MARKERS
from strandline.functions.timestamps import canonical, instant_us, let

COLUMNS = ["line_no", "role", "content", "timestamp", "source_file", "source_type", "sender", "metadata"]

# Lower-case beginnings of notices that WhatsApp writes itself.
NOTICES = (
    "los mensajes y las llamadas están cifrados", "messages and calls are end-to-end encrypted", "se actualizó la duración de los mensajes",
    "se actualizaron los mensajes temporales", "se activaron los mensajes temporales", "se desactivaron los mensajes temporales",
    "disappearing messages were turned on", "disappearing messages were turned off", "you changed the disappearing messages timer",
)
# The header of a WhatsApp line, in the Android and in the iOS form; groups 1 and 2 are stamp and body.
_STAMP = r"\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp](?:\s*\.\s*[Mm]\.?)?|[AaPp][Mm])?"
HEADERS = (rf"(?U)^[﻿‎‏]*({_STAMP})\s*-\s*(.*)$", rf"(?U)^[﻿‎‏]*\[({_STAMP})\]\s*(.*)$")
# Names under which records keep role, content and time, in order of preference.
ROLE_FIELDS = ("role", "speaker", "from", "sender", "author")
CONTENT_FIELDS = ("content", "text", "message", "body", "value", "memory")
TIME_FIELDS = ("timestamp", "date", "time", "datetime", "created_at", "ts")
CSV_SPEAKER = ("speaker", "sender", "from", "role", "author", "name")
CSV_CONTENT = ("content", "text", "message", "body", "value")
CSV_TIME = ("timestamp", "date", "time", "datetime", "created_at")
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
LEAST_CHARS = 20


def whole_files(spark: SparkSession, path: str, pattern: str | None = None, deep: bool = False) -> DataFrame:
    """(file, path, text) of each file, without a byte order mark."""
    reader = spark.read.option("recursiveFileLookup", deep)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.regexp_replace("value", "^﻿", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(file, path, line_no from 1, line)."""
    return files.select("file", "path", F.posexplode(F.split("text", LINE_END)).alias("i", "line")).select("file", "path", (F.col("i") + 1).alias("line_no"), "line")


def _shape(df: DataFrame) -> DataFrame:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    have = set(df.columns)
    defaults = {"line_no": F.lit(None).cast("int"), "sender": F.lit(None).cast("string"), "metadata": empty}
    return df.select(*[F.col(c) if c in have else defaults[c].alias(c) for c in COLUMNS])


# -- WhatsApp ----------------------------------------------------------------------------------------------------------


def is_notice(body: Column) -> Column:
    low = F.lower(collapse(body))
    out = F.lit(False)
    for start in NOTICES:
        out = out | low.startswith(start)
    return out


def whatsapp_time(stamp: Column) -> Column:
    """ISO text of a WhatsApp stamp; the stamp itself, tidied, where it is no time.

    Day first where the meridiem is written with points or the first number exceeds 12, month first otherwise; the
    other order where that one gives no date.
    """
    pointed = stamp.rlike(r"(?iU)[ap]\s*\.\s*m\.?")
    tidy = F.regexp_replace(F.regexp_replace(stamp, "[‎‏﻿]", ""), r"(?iU)([ap])\s*\.\s*m\.?", "$1M")
    tidy = collapse(tidy)
    form = r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2}),? (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AP])M)?$"
    parts = F.when(tidy.rlike(form), F.split(F.regexp_replace(tidy, form, "$1|$2|$3|$4|$5|$6|$7"), r"\|", 7))

    def build(p: Column) -> Column:
        n = lambda i: F.get(p, F.lit(i)).try_cast("int")
        half = F.upper(F.get(p, F.lit(6)))
        hour = F.when(half == "", n(3)).when((n(3) < 1) | (n(3) > 12), F.lit(None).cast("int")).otherwise(n(3) % 12 + F.when(half == "P", 12).otherwise(0))
        year = F.when(F.length(F.get(p, F.lit(2))) == 4, n(2)).when(n(2) < 69, n(2) + 2000).otherwise(n(2) + 1900)
        at = lambda m, d: F.try_make_timestamp(year, m, d, hour, n(4), F.coalesce(n(5), F.lit(0)), F.lit("UTC"))
        day_first = pointed | (n(0) > 12)
        return F.coalesce(F.when(day_first, at(n(1), n(0))).otherwise(at(n(0), n(1))), at(n(0), n(1)), at(n(1), n(0)))

    return F.coalesce(F.when(parts.isNotNull(), let(parts, lambda p: iso(build(p)))), tidy)


def _headed(spark: SparkSession, path: str) -> DataFrame:
    ls = lines(whole_files(spark, path))
    which = F.when(F.col("line").rlike(HEADERS[0]), 0).when(F.col("line").rlike(HEADERS[1]), 1)
    take = lambda g: F.when(F.col("which") == 0, F.regexp_extract("line", HEADERS[0], g)).when(F.col("which") == 1, F.regexp_extract("line", HEADERS[1], g))
    return ls.withColumn("which", which).withColumn("stamp", take(1)).withColumn("body", take(2))


def _sender(body: Column) -> Column:
    return F.when(F.instr(body, ":") > 0, strip(F.substring_index(body, ":", 1)))


def whatsapp(spark: SparkSession, path: str, persona: str = "", exact: bool = False) -> DataFrame:
    """A text export. Lines without header continue the message before; notices, lines without sender and media markers are dropped."""
    h = _headed(spark, path).withColumn("group", F.sum(F.when(F.col("which").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("line_no")))
    rest = F.expr("substring(body, instr(body, ':') + 1)")
    text = F.when(F.col("which").isNotNull(), strip(rest)).otherwise(F.col("line"))
    head = F.struct("line_no", "stamp", "body")
    grouped = h.where("group > 0").groupBy("path", "file", "group").agg(
        F.min(F.when(F.col("which").isNotNull(), head)).alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "\n").alias("content")
    )
    rows = grouped.withColumn("sender", _sender(F.col("h.body"))).withColumn("content", strip(F.col("content")))
    kept = rows.where((F.col("sender") != "") & ~is_notice(F.col("h.body")) & (F.col("content") != "") & ~F.lower("content").isin(*MEDIA_MARKERS))
    return _shape(kept.select(F.col("h.line_no"), persona_role(F.col("sender"), persona, exact).alias("role"), "content", whatsapp_time(F.col("h.stamp")).alias("timestamp"), F.col("file").alias("source_file"), F.lit("whatsapp").alias("source_type"), "sender"))


def whatsapp_rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, rejected): headed lines that are no messages."""
    h = _headed(spark, path).where("which is not null")
    bad = is_notice(F.col("body")) | (F.coalesce(_sender(F.col("body")), F.lit("")) == "")
    return h.groupBy("file").agg(F.sum(bad.cast("long")).alias("rejected"))


# -- JSON chat exports -------------------------------------------------------------------------------------------------


def _variant_text(v: Column) -> Column:
    """The string in a variant, null where it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def telegram(spark: SparkSession, path: str, persona: str = "", exact: bool = False) -> DataFrame:
    """result.json: chats.list[].messages[]; text may be a string or a list of strings and objects."""
    schema = "chats struct<list: array<struct<name: string, messages: array<struct<`from`: string, from_id: string, text: variant, date: string>>>>>"
    chats = whole_files(spark, path).select(F.explode(F.from_json("text", schema)["chats"]["list"]).alias("c"))
    m = chats.select(F.col("c.name").alias("chat"), F.posexplode("c.messages").alias("i", "m"))
    parts = F.try_variant_get(F.col("m.text"), "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(_variant_text(p), F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    text = strip(F.coalesce(_variant_text(F.col("m.text")), joined, F.try_variant_get(F.col("m.text"), "$", "string"), F.lit("")))
    sender = F.coalesce("m.from", "m.from_id", F.lit(""))
    rows = m.select((F.col("i") + 1).alias("line_no"), text.alias("content"), F.col("m.date").alias("timestamp"), sender.alias("sender"), F.create_map(F.lit("chat"), F.coalesce("chat", F.lit(""))).alias("metadata"))
    return _shape(rows.where("content != ''").withColumns({"role": persona_role(F.col("sender"), persona, exact), "source_file": F.lit("telegram-export"), "source_type": F.lit("telegram")}))


def _stamp(v: Column) -> Column:
    """A variant stamp as text: numbers as ISO, strings as they are, nothing else."""
    number = F.try_variant_get(v, "$", "double")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(number.isNotNull() & (number != 0), epoch_iso(number))


def signal(spark: SparkSession, path: str, persona: str = "", exact: bool = False) -> DataFrame:
    """A list of messages with sender or source, body or text, and a number of seconds or milliseconds."""
    schema = "array<struct<sender: string, source: string, body: string, text: string, timestamp: variant>>"
    m = whole_files(spark, path).select(F.posexplode(F.from_json("text", schema)).alias("i", "m"))
    rows = m.select((F.col("i") + 1).alias("line_no"), strip(F.coalesce("m.body", "m.text", F.lit(""))).alias("content"), _stamp(F.col("m.timestamp")).alias("timestamp"), F.coalesce("m.sender", "m.source", F.lit("")).alias("sender"))
    return _shape(rows.where("content != ''").withColumns({"role": persona_role(F.col("sender"), persona, exact), "source_file": F.lit("signal-export"), "source_type": F.lit("signal")}))


_SMS = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("line_no", T.IntegerType()), ("text", T.StringType()), ("is_from_me", T.BooleanType()), ("date", T.LongType()), ("handle", T.StringType()))])


def _sms_rows(batches):
    import sqlite3

    for pdf in batches:
        for path, blob in zip(pdf["path"], pdf["content"], strict=True):
            base = sqlite3.connect(":memory:")
            base.deserialize(blob)
            found = base.execute("select m.text, m.is_from_me, m.date, h.id from message m left join handle h on m.handle_id = h.rowid where m.text is not null and m.text != '' order by m.date, m.rowid").fetchall()
            base.close()
            yield pd.DataFrame([(path.rsplit("/", 1)[-1], i, t, bool(me), d, h) for i, (t, me, d, h) in enumerate(found, 1)], columns=[f.name for f in _SMS])


def imessage(spark: SparkSession, path: str, persona: str = "") -> DataFrame:
    """An SQLite database with message and handle; dates are nanoseconds from 2001. Opened in memory, one file a task."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_sms_rows, _SMS)
    date = F.when(F.col("date") != 0, iso(F.timestamp_micros((F.col("date") / 1000).cast("long") + F.lit(978307200_000000))))
    sender = F.when(F.col("is_from_me"), F.lit(persona)).otherwise(F.coalesce("handle", F.lit("")))
    meta = F.create_map(F.lit("handle"), F.coalesce("handle", F.lit("")), F.lit("is_from_me"), F.col("is_from_me").cast("string"))
    rows = raw.select("line_no", F.when(F.col("is_from_me"), "assistant").otherwise("user").alias("role"), strip(F.col("text")).alias("content"), date.alias("timestamp"), F.col("file").alias("source_file"), F.lit("imessage").alias("source_type"), sender.alias("sender"), meta.alias("metadata"))
    return _shape(rows.where("content != ''"))


# -- social archives ---------------------------------------------------------------------------------------------------


def _after_bracket(text: Column) -> Column:
    return F.when(F.instr(text, "[") > 0, F.expr("substring(text, instr(text, '['))"))


def _tweet_time(stamp: Column) -> Column:
    """ISO text with +00:00, or the stamp itself where it is no time."""
    us = instant_us(canonical(stamp), F.lit("UTC"), F.lit(False), F.lit(False))
    return F.coalesce(F.when(us.isNotNull(), F.concat(iso(F.timestamp_micros(us)), F.lit("+00:00"))), stamp)


def twitter(spark: SparkSession, root: str) -> DataFrame:
    """data/tweets.js: own tweets, without retweets and t.co links."""
    fields = "full_text: string, text: string, created_at: string, id_str: string, in_reply_to_screen_name: string, quoted_status: variant, quoted_status_id_str: variant"
    schema = f"array<struct<tweet: struct<{fields}>, {fields}>>"
    t = whole_files(spark, f"{root}/data/tweets.js").select(F.posexplode(F.from_json(_after_bracket(F.col("text")), schema)).alias("i", "x"))
    f = lambda c: F.when(F.col("x.tweet").isNotNull(), F.col(f"x.tweet.{c}")).otherwise(F.col(f"x.{c}"))
    raw = F.coalesce(f("full_text"), f("text"), F.lit(""))
    meta = F.create_map(
        F.lit("tweet_id"), F.coalesce(f("id_str"), F.lit("")), F.lit("is_reply"), f("in_reply_to_screen_name").isNotNull().cast("string"), F.lit("is_quote"), (f("quoted_status").isNotNull() | f("quoted_status_id_str").isNotNull()).cast("string"), F.lit("reply_to"), F.coalesce(f("in_reply_to_screen_name"), F.lit(""))
    )
    rows = t.select((F.col("i") + 1).alias("line_no"), raw.alias("raw"), strip(F.regexp_replace(raw, r"(?U)https?://t\.co/\S+", "")).alias("content"), _tweet_time(f("created_at")).alias("timestamp"), meta.alias("metadata"))
    kept = rows.where(~F.col("raw").startswith("RT @") & (F.col("content") != ""))
    return _shape(kept.withColumns({"role": F.lit("assistant"), "source_file": F.lit("tweets.js"), "source_type": F.lit("twitter")}))


def twitter_dms(spark: SparkSession, root: str) -> DataFrame:
    """data/direct-messages.js: every message counts as the owner's."""
    schema = "array<struct<dmConversation: struct<messages: array<struct<messageCreate: struct<text: string, senderId: string, createdAt: string>>>>>>"
    c = whole_files(spark, f"{root}/data/direct-messages.js").select(F.explode(F.from_json(_after_bracket(F.col("text")), schema)["dmConversation"]["messages"]).alias("ms"))
    m = c.select(F.posexplode("ms").alias("i", "m")).select((F.col("i") + 1).alias("line_no"), strip(F.coalesce("m.messageCreate.text", F.lit(""))).alias("content"), F.col("m.messageCreate.createdAt").alias("timestamp"), F.create_map(F.lit("sender_id"), F.coalesce("m.messageCreate.senderId", F.lit(""))).alias("metadata"))
    return _shape(m.where("content != ''").withColumns({"role": F.lit("assistant"), "source_file": F.lit("direct-messages.js"), "source_type": F.lit("twitter-dm")}))


def instagram_posts(spark: SparkSession, root: str) -> DataFrame:
    """content/posts_*.json: title or caption of each medium, or of the post where it lists none."""
    schema = "array<struct<media: array<struct<title: string, caption: string, creation_timestamp: variant>>, title: string, caption: string, creation_timestamp: variant>>"
    p = whole_files(spark, f"{root}/content", "posts_*.json").select("file", F.posexplode(F.from_json("text", schema)).alias("i", "p"))
    one = F.array(F.struct(F.col("p.title").alias("title"), F.col("p.caption").alias("caption"), F.col("p.creation_timestamp").alias("creation_timestamp")))
    m = p.select("file", "i", F.explode(F.when(F.col("p.media").isNotNull(), F.col("p.media")).otherwise(one)).alias("m"))
    rows = m.select((F.col("i") + 1).alias("line_no"), strip(F.coalesce("m.title", "m.caption", F.lit(""))).alias("content"), _stamp(F.col("m.creation_timestamp")).alias("timestamp"), F.col("file").alias("source_file"), F.create_map(F.lit("type"), F.lit("post")).alias("metadata"))
    return _shape(rows.where("content != ''").withColumns({"role": F.lit("assistant"), "source_type": F.lit("instagram")}))


def instagram_dms(spark: SparkSession, root: str, persona: str = "") -> DataFrame:
    """messages/inbox/*/message_*.json."""
    schema = "messages array<struct<content: string, sender_name: string, timestamp_ms: variant>>"
    f = whole_files(spark, f"{root}/messages/inbox/*", "message_*.json")
    m = f.select("path", F.posexplode(F.from_json("text", schema)["messages"]).alias("i", "m"))
    place = F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1))
    rows = m.select((F.col("i") + 1).alias("line_no"), strip(F.coalesce("m.content", F.lit(""))).alias("content"), _stamp(F.col("m.timestamp_ms")).alias("timestamp"), place.alias("source_file"), F.coalesce("m.sender_name", F.lit("")).alias("sender"))
    return _shape(rows.where("content != ''").withColumns({"role": persona_role(F.col("sender"), persona), "source_type": F.lit("instagram-dm")}))


# -- documents ---------------------------------------------------------------------------------------------------------


def strip_wikilinks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]]+)\]\]", "$1")


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """(fields as a string map, lists as `[a, b]` text; body). Without a closed front block the text is all body."""
    has = text.startswith("---") & (F.instr(F.substring(text, 4, 1_000_000_000), "---") > 0)
    block = F.regexp_extract(text, r"(?s)^---(.*?)---", 1)
    body = F.when(has, strip(F.regexp_replace(text, r"(?s)^---.*?---", ""))).otherwise(text)
    keyed = F.filter(F.split(block, LINE_END), lambda x: F.instr(x, ":") > 0)
    entries = F.transform(keyed, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.when(has, last).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), body


def tags(front: Column) -> Column:
    """The tags field as a list."""
    raw = F.coalesce(front["tags"], F.lit(""))
    inner = F.regexp_extract(raw, r"^\[(.*)\]$", 1)
    return F.when(raw == "", F.array().cast("array<string>")).when(raw.rlike(r"^\[.*\]$"), F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", ""))).otherwise(F.array(raw))


def _ignored(root_path: str, spark: SparkSession) -> list[str]:
    patterns = [".obsidian", ".trash", "node_modules", ".raw"]
    for name in (".obsidianignore", ".gitignore"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root_path}/{name}")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(where):
            # Ignore files are a few lines of configuration; Spark's own readers leave out hidden files.
            stream = fs.open(where)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            patterns += [x.rstrip("/") for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]
    return patterns


def markdown(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """A directory of Markdown (or one file): bodies of 20 characters or more, front matter and tags in the metadata.

    Hidden and ignored paths are left out; documents older than `since` too, those without a readable date never.
    A JSON sidecar .raw/<stem>.json beside a document is attached as metadata.raw_data.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    single = system.getFileStatus(fs).isFile()
    base = system.makeQualified(fs).toUri().getPath()
    files = whole_files(spark, root, None if single else "*.md", not single)
    rel = F.col("file") if single else F.expr("substring(plain, instr(plain, base) + length(base) + 1)")
    plain = F.url_decode(F.regexp_replace("path", "^[a-z]+:/{0,2}(?=/)", ""))
    docs = files.withColumn("plain", plain).withColumn("base", F.lit(base)).withColumn("rel", rel)
    if not single:
        for p in _ignored(root, spark):
            docs = docs.where(~(F.array_contains(F.split("rel", "/"), p) | F.col("rel").startswith(p)))
        docs = docs.where(~F.exists(F.split("rel", "/"), lambda x: x.startswith(".")))
    front, body = split_frontmatter(F.col("text"))
    docs = docs.withColumn("front", front).withColumn("content", strip(strip_wikilinks(body))).where(F.length("content") >= LEAST_CHARS)
    dated = F.coalesce(*[F.when(F.length(F.col("front")[k]) >= 8, F.col("front")[k]) for k in ("date", "created", "created_at", "timestamp")], F.nullif(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), iso(F.col("modified")))
    docs = docs.withColumn("timestamp", dated)
    if since:
        docs = docs.where(F.try_to_timestamp("timestamp").isNull() | (F.try_to_timestamp("timestamp") >= F.lit(since).cast("timestamp")))
    kind = "markdown"
    meta = F.create_map(F.lit("frontmatter"), F.to_json("front"), F.lit("tags"), F.to_json(tags(F.col("front"))))
    if not single:
        exists = lambda p: bool(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")) or [])
        raw_dirs, deep = [], ""
        while exists(f"{deep}*"):
            raw_dirs += [f"{deep}.raw"] * exists(f"{deep}.raw")
            deep += "*/"
        kind = "obsidian" if exists(".obsidian") else "gbrain-export" if raw_dirs else "markdown"
        if raw_dirs:
            side = whole_files(spark, f"{root}/{raw_dirs[0]}", "*.json")
            for p in raw_dirs[1:]:
                side = side.unionByName(whole_files(spark, f"{root}/{p}", "*.json"))
            at = F.regexp_replace(F.url_decode(F.regexp_replace("path", "^[a-z]+:/{0,2}(?=/)", "")), r"/\.raw/([^/]*)\.json$", "/$1.md")
            side = side.where(F.try_parse_json("text").isNotNull()).select(at.alias("plain"), F.col("text").alias("raw_data"))
            docs = docs.join(side, "plain", "left")
            meta = F.when(F.col("raw_data").isNotNull(), F.map_concat(meta, F.create_map(F.lit("raw_data"), F.col("raw_data")))).otherwise(meta)
    return _shape(docs.select(F.lit(1).alias("line_no"), F.lit("assistant").alias("role"), "content", "timestamp", F.col("rel").alias("source_file"), F.lit(kind).alias("source_type"), meta.alias("metadata")))


def _paragraphs(files: DataFrame, kind: str) -> DataFrame:
    p = files.select("file", F.posexplode(F.split("text", r"\n{2,}")).alias("i", "p")).select((F.col("i") + 1).alias("line_no"), strip(F.col("p")).alias("content"), F.col("file").alias("source_file"))
    return _shape(p.where(F.length("content") >= LEAST_CHARS).withColumns({"role": F.lit("assistant"), "timestamp": F.lit(None).cast("string"), "source_type": F.lit(kind)}))


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of 20 characters or more."""
    return _paragraphs(whole_files(spark, path), "plaintext")


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of the pages' text; needs pdfplumber or PyPDF2 on the executors."""

    def pages(batches):
        import io

        try:
            import pdfplumber

            read = lambda b: [p.extract_text() or "" for p in pdfplumber.open(io.BytesIO(b)).pages]
        except ImportError:
            try:
                from PyPDF2 import PdfReader
            except ImportError:
                raise ImportError("PDF parsing requires pdfplumber or PyPDF2.") from None
            read = lambda b: [p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages]
        for pdf_ in batches:
            yield pd.DataFrame({"file": [p.rsplit("/", 1)[-1] for p in pdf_["path"]], "text": ["\n\n".join(read(b)) for b in pdf_["content"]]})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return _paragraphs(raw.mapInPandas(pages, "file string, text string"), "pdf")


def csv(spark: SparkSession, path: str, persona: str = "", delimiter: str | None = None) -> DataFrame:
    """A table with a header; columns are found by name, in any case. The delimiter is sniffed from the first line."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).first()
        delimiter = max(",;\t|", key=lambda d: (first[0] if first else "").count(d))
    df = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').csv(path)
    by = {c.lower(): c for c in df.columns}
    speaker, content, time = (next((by[c] for c in names if c in by), None) for names in (CSV_SPEAKER, CSV_CONTENT, CSV_TIME))
    if content is None:
        return _shape(spark.createDataFrame([], "role string, content string, timestamp string, source_file string, source_type string"))
    said = F.coalesce(F.col(f"`{speaker}`"), F.lit("")) if speaker else F.lit("")
    role = F.lit("assistant") if not speaker else persona_role(said, persona)
    meta = F.when(said != "", F.create_map(F.lit("speaker"), said)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = df.select(role.alias("role"), strip(F.col(f"`{content}`")).alias("content"), (F.col(f"`{time}`") if time else F.lit(None).cast("string")).alias("timestamp"), F.col("_metadata.file_name").alias("source_file"), F.lit("csv").alias("source_type"), meta.alias("metadata"))
    return _shape(rows.where("content != ''"))


# -- records -----------------------------------------------------------------------------------------------------------


def _field(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that the record has, even if it is null there: as JSON text."""
    out = F.lit(None).cast("string")
    keys = F.json_object_keys(record)
    for n in reversed(names):
        out = F.when(F.array_contains(keys, n), F.get_json_object(record, f"$.{n}")).otherwise(out)
    return out


def normalise_records(records: DataFrame, persona: str = "") -> DataFrame:
    """(line_no, source_file, record as JSON text) to messages: role, content and time by the first name present, the rest as metadata."""
    content, role, time = (_field(F.col("record"), n) for n in (CONTENT_FIELDS, ROLE_FIELDS, TIME_FIELDS))
    number = F.when(time.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), time.try_cast("double"))
    known = [*ROLE_FIELDS, *CONTENT_FIELDS, *TIME_FIELDS]
    rest = F.map_filter(F.from_json("record", "map<string,string>"), lambda k, v: ~k.isin(*known))
    rows = records.select("line_no", label_role(F.coalesce(role, F.lit("")), persona).alias("role"), strip(content).alias("content"), F.coalesce(F.when(number.isNotNull() & (number != 0), epoch_iso(number)), F.nullif(time, F.lit(""))).alias("timestamp"), "source_file", F.lit("jsonl").alias("source_type"), rest.alias("metadata"))
    return _shape(rows.where("content is not null and content != ''"))


def jsonl(spark: SparkSession, path: str, persona: str = "") -> DataFrame:
    """One JSON object a line; blank and malformed lines are skipped.

    Files are read in splits, so one may be of any size. line_no is the line's byte order made dense: splits of a file are
    counted, and what lies before a split is added to the lines' places in it.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")
    sizes = read.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = read.join(F.broadcast(sizes.withColumn("before", before).select("path", "split", "first", "before")), ["path", "split"])
    record = strip(F.regexp_replace("value", "^\ufeff", ""))
    rows = placed.select((F.col("before") + F.col("place") - F.col("first") + 1).cast("int").alias("line_no"), F.col("file").alias("source_file"), record.alias("record"))
    return normalise_records(rows.where(F.json_object_keys("record").isNotNull()), persona)


def _items(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, source_file, record, memories) of a JSON file: its list, its `memories`, or itself."""
    text = F.col("text")
    memories = F.get_json_object(text, "$.memories")
    listed = F.when(strip(text).startswith("["), text).otherwise(F.coalesce(memories, F.concat(F.lit("["), text, F.lit("]"))))
    files = whole_files(spark, path).withColumn("memories", memories.isNotNull())
    each = files.select("file", "memories", F.posexplode(F.from_json(listed, "array<string>")).alias("i", "record"))
    return each.select((F.col("i") + 1).alias("line_no"), F.col("file").alias("source_file"), "record", "memories").where(F.json_object_keys("record").isNotNull())


def gbrain(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Memories of one entity, from a list or under `memories`."""
    content, time = _field(F.col("record"), CONTENT_FIELDS), _field(F.col("record"), TIME_FIELDS)
    meta = F.create_map(F.lit("entity"), F.lit(entity), F.lit("memory_id"), F.coalesce(F.get_json_object("record", "$.id"), F.lit("")), F.lit("tags"), F.coalesce(F.get_json_object("record", "$.tags"), F.lit("[]")))
    rows = _items(spark, path).select("line_no", F.lit("assistant").alias("role"), strip(content).alias("content"), F.nullif(time, F.lit("")).alias("timestamp"), F.lit("gbrain-export").alias("source_file"), F.lit("gbrain").alias("source_type"), meta.alias("metadata"))
    return _shape(rows.where("content is not null and content != ''"))


def json_file(spark: SparkSession, path: str, persona: str = "", entity: str = "") -> DataFrame:
    """A JSON list or object of records; with an entity, or where it has `memories`, as gbrain."""
    if entity or _items(spark, path).where("memories").limit(1).count():
        return gbrain(spark, path, entity or persona)
    return normalise_records(_items(spark, path), persona)


# -- choosing a reader -------------------------------------------------------------------------------------------------


def detect(spark: SparkSession, path: str) -> str | None:
    """The reader for a path: social, markdown, imessage, whatsapp, telegram, signal, or by extension; None if none fits."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    p = hadoop(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    if fs.getFileStatus(p).isDirectory():
        if fs.exists(hadoop(f"{path}/data/tweets.js")):
            return "twitter"
        return "instagram" if fs.exists(hadoop(f"{path}/content/posts_1.json")) else "markdown"
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "txt":
        headed = _headed(spark, path).where("which is not null").where(F.coalesce(_sender(F.col("body")), F.lit("")) != "")
        return "whatsapp" if headed.limit(1).count() else "txt"
    if suffix == "json":
        keys = whole_files(spark, path).select(F.json_object_keys("text").alias("k"), F.json_object_keys(F.get_json_object("text", "$[0]")).alias("first")).first()
        if keys and keys["k"] and "chats" in keys["k"]:
            return "telegram"
        return "signal" if keys and keys["first"] and "sender" in keys["first"] else "json"
    return {"db": "imessage", "jsonl": "jsonl", "csv": "csv", "pdf": "pdf", "md": "markdown"}.get(suffix)


def read(spark: SparkSession, path: str, persona: str = "", since: str | None = None, exact: bool = False, entity: str = "") -> DataFrame:
    """The messages of a path by the reader that detect chooses; `since` holds for every source, rows without date stay."""
    kind = detect(spark, path)
    if kind == "twitter":
        out = twitter(spark, path)
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/direct-messages.js")
        out = out.unionByName(twitter_dms(spark, path)) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else out
    elif kind == "instagram":
        out = instagram_posts(spark, path)
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/messages/inbox")
        out = out.unionByName(instagram_dms(spark, path, persona)) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else out
    elif kind in ("whatsapp", "telegram", "signal"):
        out = {"whatsapp": whatsapp, "telegram": telegram, "signal": signal}[kind](spark, path, persona, exact)
    elif kind == "markdown":
        return markdown(spark, path, since)
    elif kind == "json":
        out = json_file(spark, path, persona, entity)
    elif kind in ("imessage", "jsonl", "csv"):
        out = {"imessage": imessage, "jsonl": jsonl, "csv": csv}[kind](spark, path, persona)
    elif kind in ("txt", "pdf"):
        out = {"txt": plain_text, "pdf": pdf}[kind](spark, path)
    else:
        raise ValueError(f"Unsupported source: {path}")
    if since:
        out = out.where(F.try_to_timestamp("timestamp").isNull() | (F.try_to_timestamp("timestamp") >= F.lit(since).cast("timestamp")))
    return out


