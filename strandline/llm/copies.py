"""Problem 1: copies of a message that differ only in formatting become one record each, with the number of copies.

Method: recursive radix partitioning on canonical bytes. Rows are counted by the next bytes of their canonical form;
buckets that hold too much are split by further bytes (runs that all their rows share are skipped) until each fits into
a size in bytes that does not depend on the input. Every bucket is then read into a trie of its own, with a counter at
each terminal node. A single form that alone exceeds a bucket cannot be split by bytes: its counter is pre-aggregated,
and its rows never meet in one task.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import clean_role, says_something
from strandline.session import durable, lookup_join, small

_WORDS = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff]")
_SEPARATORS = [re.compile(r"[\r\n]+"), re.compile(r";"), re.compile(r"\|"), re.compile(r"[\r\n;|]+")]
#: A bucket fits up to this many bytes, each row counting its key and what a trie keeps besides; and the bytes by which it is split.
FIT_BYTES, ROW_BYTES, STRIDE = 8 * 2**20, 64, 2


def words(text: str) -> list[str]:
    """Runs of letters or digits after NFKC, without case."""
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return _WORDS.findall(folded)


def fields(text: str) -> list[tuple[str, str]] | None:
    """The (key, value) fields of content that consists of nothing else, three at least; else None."""
    if ":" not in text:
        return None
    i, j = text.find("{"), text.rfind("}")
    if 0 <= i < j and not _WORDS.search(text[:i]) and not _WORDS.search(text[j + 1 :]):
        try:
            # White space of any kind, or none to be seen, does not make it another object.
            obj = json.loads(_INVISIBLE.sub("", re.sub(r"\s", " ", text[i : j + 1])), object_pairs_hook=list)
        except (ValueError, RecursionError):
            obj = None
        if isinstance(obj, list) and len(obj) >= 3 and all(isinstance(x, tuple) for x in obj):
            return [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in obj]
    if text.count(":") < 3:
        return None
    for sep in _SEPARATORS:
        parts = [p for p in sep.split(text) if _WORDS.search(p)]
        if len(parts) >= 3 and all(":" in p for p in parts):
            pairs = [p.split(":", 1) for p in parts]
            if all(_WORDS.search(k) for k, _ in pairs):
                return [(k, v) for k, v in pairs]
    return None


def canonical(text: str) -> str:
    """The words in order, or, for fields, their words in the order of the fields; '' where there is no word.

    Forms of fields are marked, and no plain form holds the marks.
    """
    found = fields(text)
    if found is None:
        return " ".join(words(text))
    return "\x01" + "\x02".join(sorted(" ".join(words(k)) + "\x03" + " ".join(words(v)) for k, v in found))


_FORMS = T.StructType([T.StructField("form", T.StringType()), T.StructField("flat", T.StringType())])


@F.pandas_udf(_FORMS)
def _forms(content: pd.Series) -> pd.DataFrame:
    forms = [canonical(x) for x in content]
    # What a record of fields says read as plain words, to meet copies that lost the marks between the fields.
    flat = [" ".join(words(x)) if f.startswith("\x01") else None for x, f in zip(content, forms, strict=True)]
    return pd.DataFrame({"form": pd.Series(forms, dtype=object), "flat": pd.Series(flat, dtype=object)})


def canonical_rows(message: DataFrame) -> DataFrame:
    """(seq, key): the canonical bytes (form, role, slug) of each message that says something, holds a word and has a role.

    A null slug is a slug of its own. Plain content whose words are those of a record of fields, in order, takes that
    record's form (the smallest, if there are several).
    """
    role = clean_role(F.col("role"))
    said = message.where((role != "") & says_something(F.col("content")) & F.col("seq").isNotNull())
    rows = said.select("seq", role.alias("role"), F.coalesce(F.col("slug"), F.lit("\x00")).alias("slug"), _forms(F.col("content")).alias("f")).where("f.form != ''")
    rows = durable(rows.select("seq", F.col("f.form").alias("form"), F.col("f.flat").alias("flat"), "role", "slug"), "p1-forms")
    key = lambda form: F.encode(F.concat(form, F.lit("\x00"), "role", F.lit("\x00"), "slug"), "UTF-8")
    flats = rows.where("flat is not null").groupBy(key(F.col("flat")).alias("key")).agg(F.min(key(F.col("form"))).alias("form_key"))
    plain = rows.select("seq", key(F.col("form")).alias("key"))
    # The bridge holds only plain forms that a record of fields also has.
    bridge = durable(flats.join(plain.select("key").distinct(), "key", "left_semi"), "p1-bridge")
    if bridge.isEmpty():
        return plain
    return lookup_join(plain, bridge, ["key"], "seq", ["form_key"]).select("seq", F.coalesce("form_key", "key").alias("key"))


@F.pandas_udf(T.IntegerType())
def _shared(low: pd.Series, high: pd.Series) -> pd.Series:
    """Bytes that two keys share from the start; for a bucket's least and greatest key, those that all its keys share."""

    def count(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
        return int(np.argmax(x != y))

    return pd.Series([count(bytes(a), bytes(b)) for a, b in zip(low, high, strict=True)])


def _sized(table_: DataFrame) -> DataFrame:
    """A table of buckets, to be broadcast where it has few rows."""
    return F.broadcast(table_) if small(table_) else table_


def radix(rows: DataFrame, fit: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Split the keys of `rows` (seq, key) into buckets that fit: (cold, hot, steps).

    cold: seq, key, leaf (a number of the bucket; equal keys have equal ones); hot: seq, first_seq, n of the rows of a form
    that alone exceeds a bucket. Each step counts the rows still open by STRIDE more bytes, pre-aggregated. Rows of
    buckets that fit are closed; of the others, the bytes that all keys of a bucket share are skipped at once, however many,
    so a step always parts rows; and only they are written for the next step. The table of oversized buckets stays in
    Spark: it is broadcast where a count shows that it is small, else joined (its buckets are large; Spark splits them).
    """
    fit = FIT_BYTES if fit is None else fit
    cut, cold, hot, steps = F.substring(F.col("key"), F.lit(1), F.col("depth") + STRIDE), [], [], 0
    left = rows.select("seq", "key", F.lit(0).alias("depth"))
    while True:
        steps += 1
        # Hashes stand for prefixes: two that fell on one number would be split and closed alike, which parts no equal keys.
        hashed = left.withColumn("bucket", F.xxhash64(cut, "depth"))
        sums = hashed.groupBy("bucket").agg(F.sum(F.length("key") + F.lit(ROW_BYTES)).alias("bytes"))
        over = durable(sums.where(F.col("bytes") > fit).select("bucket"), "p1-buckets")
        if over.isEmpty():
            cold.append(left.select("seq", "key", F.xxhash64(cut, "depth").alias("leaf")))
            break
        table = _sized(over)
        cold.append(hashed.join(table, "bucket", "left_anti").select("seq", "key", F.col("bucket").alias("leaf")))
        inside = hashed.join(table, "bucket")
        ends = inside.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
        ends = durable(ends.select("bucket", F.when(F.col("low") == F.col("high"), F.col("first_seq")).alias("first_seq"), "n", _shared("low", "high").alias("shared")), "p1-ends")
        placed = inside.join(_sized(ends), "bucket")
        hot.append(placed.where("first_seq is not null").select("seq", "first_seq", "n"))
        left = durable(placed.where("first_seq is null").select("seq", "key", F.greatest("shared", F.col("depth") + STRIDE).cast("int").alias("depth")), "p1-open")
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    none = rows.limit(0).select("seq", F.col("seq").alias("first_seq"), F.lit(0).cast("long").alias("n"))
    return union(cold), union(hot) if hot else none, steps


class Trie:
    """Keys by their bytes, runs without branches in one node; a key's terminal counts it and keeps the least number and, if asked to, all.

    A node is [label, children by first byte, count, first, members].
    """

    def __init__(self, members: bool = True):
        self.top: list = [b"", {}, 0, None, None]
        self.terminals: list[list] = []
        self.members = members

    def add(self, key: bytes, number: int) -> None:
        node, at, n = self.top, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, 0, None, None]
                node = child
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = 1
            most = min(len(label), n - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            fork = node[1][key[at]] = [label[:same], {label[same]: child}, 0, None, None]
            child[0] = label[same:]
            node, at = fork, at + same
        if not node[2]:
            node[3], node[4] = number, [number] if self.members else None
            self.terminals.append(node)
        else:
            node[3] = min(node[3], number)
            if self.members:
                node[4].append(number)
        node[2] += 1


def _tries(batches: Iterator[pa.RecordBatch], members: bool) -> Iterator[Trie]:
    """One trie per bucket, of rows that are sorted by bucket; one is held at a time."""
    leaf, trie = None, Trie(members)
    for batch in batches:
        for bucket, key, seq in zip(batch.column("leaf").to_pylist(), batch.column("key").to_pylist(), batch.column("seq").to_pylist(), strict=True):
            if bucket != leaf:
                if trie.terminals:
                    yield trie
                leaf, trie = bucket, Trie(members)
            trie.add(key, seq)
    if trie.terminals:
        yield trie


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for trie in _tries(batches, True):
        first = np.repeat(np.array([t[3] for t in trie.terminals], np.int64), [t[2] for t in trie.terminals])
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array([s for t in trie.terminals for s in t[4]], pa.int64())], names=["first_seq", "seq"])


def _counter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for trie in _tries(batches, False):
        yield pa.RecordBatch.from_arrays([pa.array([t[3] for t in trie.terminals], pa.int64()), pa.array([t[2] for t in trie.terminals], pa.int64())], names=["first_seq", "copies"])


def _placed(message: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows by bucket, rows of hot forms)."""
    cold, hot, _ = radix(durable(canonical_rows(message), "p1-keys"))
    return cold.select("leaf", "key", F.col("seq").cast("long").alias("seq")).repartition("leaf").sortWithinPartitions("leaf"), hot


def members(message: DataFrame) -> DataFrame:
    """(first_seq, seq) of every member of every record; the first member has seq = first_seq."""
    cold, hot = _placed(message)
    return cold.mapInArrow(_member_rows, "first_seq long, seq long").unionByName(hot.select("first_seq", "seq"))


def found(message: DataFrame) -> DataFrame:
    """(first_seq, seq): one row per member of a record except its smallest seq, which is first_seq.

    Repeated rows of one seq are members once each, so an input without unique seq may give first_seq = seq; those are
    left out.
    """
    return members(message).where("seq != first_seq")


def records(message: DataFrame) -> DataFrame:
    """(first_seq, copies): each record once, with its number of copies: what the counters of the terminals say."""
    cold, hot = _placed(message)
    return cold.mapInArrow(_counter_rows, "first_seq long, copies long").unionByName(hot.select("first_seq", F.col("n").alias("copies")).distinct())
