"""Problem 8: documents in which a passage of a held-out item stands, whole or in part.

Method: winnowing. Of each window of word k-grams the smallest hash is kept, for documents and items alike, so every
shared run of at least k + window - 1 words leaves a common fingerprint. Fingerprints are joined, and pairs with
enough hits are extended by an exact alignment over the words.

With k = 3 and a window of 2 every shared run of four words is found. A passage of n words with at most n / 6 edits
consists of at most n / 6 + 1 unchanged runs, so one of 16 words or more shares at least two fingerprints.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import durable, lookup_pairs, small

K, WINDOW = 3, 2
LEAST_WORDS, ONE_IN = 16, 6
LEAST_HITS = 2

_TAGS = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>")
_LINKS = re.compile(r"\]\([^()\s]{1,300}\)")
_WORDS = re.compile(r"[^\W_]+")


class _Plain(dict):
    """Translation of characters to what is left of them without accents, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return out


_PLAIN = _Plain()


def words(text: str) -> list[str]:
    """Words without case, accents, punctuation and markup."""
    text = text.replace("\u00ad", "").replace("\u200b", "")
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "](" in text:
        text = _LINKS.sub("] ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.casefold().translate(_PLAIN)
    return _WORDS.findall(text.lower())


class Hashes(dict):
    """Hashes of words, each computed once; emptied where it has grown to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def winnow(texts: list[list[str]], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, fingerprint) arrays of the winnowed k-grams of many texts at once; texts under k words have none.

    Of each window of k-grams the least is kept, the last of them where equal; a text shorter than a window gives its least.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.fromiter((hashes[w] for ws in texts for w in ws), np.uint64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    n = len(h) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        g = h[:n] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(1, K):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + n]
        g ^= g >> np.uint64(32)
    g = g.view(np.int64)
    whole = text[:n] == text[K - 1 :]
    at, of = np.flatnonzero(whole), text[:n][whole]
    g = g[whole]
    keep = np.zeros(len(g), dtype=bool)
    if len(g) >= WINDOW:
        view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        inside = of[: len(view)] == of[WINDOW - 1 :]
        last = WINDOW - 1 - np.argmin(view[inside][:, ::-1], axis=1)
        keep[np.flatnonzero(inside) + last] = True
    grams = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(grams) - grams
    for t in np.flatnonzero((grams > 0) & (grams < WINDOW)):
        keep[starts[t] + int(np.argmin(g[starts[t] : starts[t] + grams[t]]))] = True
    first_word = np.cumsum(sizes) - sizes
    return of[keep], at[keep] - first_word[of[keep]], g[keep]


def fingerprints(ws: list[str]) -> tuple[list[int], list[int]]:
    """(hashes, word positions) of the winnowed k-grams of one text."""
    _, at, g = winnow([ws], Hashes())
    return g.tolist(), at.tolist()


_MARKS = T.StructType([T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("pos", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_MARKS)
def _fingerprints(text: pd.Series) -> pd.DataFrame:
    out = [fingerprints(words(x)) if x is not None else ([], []) for x in text]
    return pd.DataFrame({"fp": [o[0] for o in out], "pos": [o[1] for o in out]})


def holds(item: list[str], doc: list[str], least: int = LEAST_WORDS, one_in: int = ONE_IN) -> bool:
    """Whether a run of `least` item words or more stands in doc with at most one word in `one_in` edited.

    A longer run that does can be halved so that a half does too, so runs of least to 2 * least - 1 words suffice.
    Edits are words changed, left out or added, at any place of the run; but where the run ends inside the item, its word
    there must stand unchanged, for else any shorter passage would count with what it lacks as edits.
    """
    m = len(doc)
    if len(item) < least or m == 0:
        return False
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    d = np.fromiter((codes.get(w, -1) for w in doc), np.int64, m)
    it = [codes[w] for w in item]
    steps = np.arange(m + 1)
    for a in range(len(item) - least + 1):
        # cost[j]: fewest edits of item[a:i] against a doc run that ends before j; inside the item its first word must match.
        if a:
            cost = np.full(m + 1, 10**6)
            starts = np.flatnonzero(d == it[a])
            if not len(starts):
                continue
            cost[starts + 1] = 0
            cost = np.minimum.accumulate(cost - steps) + steps
        else:
            cost = np.minimum(1 - np.concatenate([[0], (d == it[0])]), 1)
        for i in range(a + 1, min(len(item), a + 2 * least - 1)):
            new = np.empty(m + 1, dtype=np.int64)
            match = d == it[i]
            new[0] = cost[0] + 1
            new[1:] = np.minimum(cost[:-1] + ~match, cost[1:] + 1)
            n = i - a + 1
            if n >= least:
                ended = new if i == len(item) - 1 else cost[:-1][match]
                if len(ended) and ended.min() * one_in <= n:
                    return True
            cost = np.minimum.accumulate(new - steps) + steps
            if cost.min() > (2 * least) // one_in:
                break
    return False


#: Items are held by every worker where their texts have at most so many characters together: some 4 bytes each there.
MOST_CHARS = 16_000_000
#: Hits of one passage differ by at most the words it gained or lost; neighbouring diagonals share a bucket of this width twice.
DIAGONAL = 16


class Items:
    """The items' words, and their fingerprints in order."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.words = [words(t) for _, t in rows]
        of, at, g = winnow(self.words, Hashes())
        order = np.argsort(g, kind="stable")
        self.of, self.at, sorted_ = of[order], at[order], g[order]
        self.fp, self.start, self.count = np.unique(sorted_, return_index=True, return_counts=True)

    def hits(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in fp, item, item position) of every common fingerprint."""
        none = np.empty(0, np.int64)
        if not len(self.fp) or not len(fp):
            return none, none, none
        where = np.searchsorted(self.fp, fp)
        where[where == len(self.fp)] = 0
        hit = np.flatnonzero(self.fp[where] == fp)
        n = self.count[where[hit]]
        rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.start[where[hit]], n) + rank
        return np.repeat(hit, n), self.of[entry], self.at[entry]

    def leaks(self, texts: list[list[str]], hashes: Hashes) -> list[tuple[int, int]]:
        """(text, item) of the texts that hold 16 words or more of an item."""
        doc, pos, fp = winnow(texts, hashes)
        place, item, item_pos = self.hits(fp)
        if not len(place):
            return []
        doc, pos = doc[place], pos[place]
        shift = pos - item_pos
        near: dict[tuple[int, int, int, int], list] = {}
        for half in (0, DIAGONAL // 2):
            for d, i, k, p, q in zip(doc.tolist(), item.tolist(), ((shift + half) // DIAGONAL).tolist(), pos.tolist(), item_pos.tolist(), strict=True):
                near.setdefault((d, i, half, k), []).append((p, q))
        found: set[tuple[int, int]] = set()
        for (d, i, _, _), hits in near.items():
            if (d, i) in found or len({q for _, q in hits}) < LEAST_HITS:
                continue
            iw, reach = self.words[i], _reach(self.words[i])
            lo, hi = min(p for p, _ in hits), max(p for p, _ in hits)
            if holds(iw, texts[d][max(0, lo - reach) : hi + reach]):
                found.add((d, i))
        return sorted(found)


def _reach(item: list[str]) -> int:
    """Words of a document before and after a hit in which the passage must lie."""
    return len(item) + len(item) // ONE_IN + 8


def _small_items(items: DataFrame) -> list[tuple[int, str]] | None:
    """The items, if their texts have at most MOST_CHARS characters in all."""
    rows = items.where("text is not null and item_id is not null").select("item_id", "text")
    if (rows.agg(F.sum(F.length("text"))).first()[0] or 0) > MOST_CHARS:
        return None
    return [(r["item_id"], r["text"]) for r in rows.collect()]


def _join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Fingerprints of documents with those of items, by a shuffle; a fingerprint that many documents hold is spread over salts."""
    return lookup_pairs(docs, items, "fp", F.xxhash64("doc_id", "pos"))


def candidates(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, lo, hi): pairs with at least two common fingerprints on about the same diagonal.

    lo and hi bound the document words around the hits.
    """
    i = items.where("text is not null").select("item_id", _fingerprints("text").alias("m")).select("item_id", F.explode(F.arrays_zip("m.fp", "m.pos")).alias("z")).select("item_id", F.col("z.fp").alias("fp"), F.col("z.pos").alias("item_pos"))
    i = durable(i, "p8-items")
    d = documents.where("text is not null").select("doc_id", _fingerprints("text").alias("m")).select("doc_id", F.explode(F.arrays_zip("m.fp", "m.pos")).alias("z")).select("doc_id", F.col("z.fp").alias("fp"), F.col("z.pos").alias("pos"))
    hits = _join(d, i)
    width = DIAGONAL
    near = F.explode(F.array(F.floor((F.col("pos") - F.col("item_pos")) / width), F.floor((F.col("pos") - F.col("item_pos")) / width + 0.5) + F.lit(1_000_000_000)))
    grouped = hits.withColumn("diagonal", near).groupBy("doc_id", "item_id", "diagonal").agg(F.countDistinct("item_pos").alias("hits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return grouped.where(F.col("hits") >= LEAST_HITS).select("doc_id", "item_id", "lo", "hi")


@F.pandas_udf(T.BooleanType())
def _confirm(text: pd.Series, item: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, i, ss in zip(text, item, spans, strict=True):
        ws, iw = words(t), words(i)
        out.append(any(holds(iw, ws[max(0, s["lo"] - _reach(iw)) : s["hi"] + _reach(iw)]) for s in ss))
    return pd.Series(out, dtype=bool)


def _scanned(documents: DataFrame, held: list[tuple[int, str]]) -> DataFrame:
    """Documents against items that every worker holds: found and confirmed where the texts are read, nothing but the pairs moves."""
    index = documents.sparkSession.sparkContext.broadcast(Items(held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, items = Hashes(), index.value
        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            pairs = items.leaks([words(t) for t in pdf["text"]], hashes)
            yield pd.DataFrame({"doc_id": [ids[d] for d, _ in pairs], "item_id": [items.ids[i] for _, i in pairs]})

    return documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, item_id long").distinct()


def _shuffled(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same for items of any number: fingerprints are joined by a shuffle, and only texts with candidates are read again."""
    pairs = durable(candidates(documents, items).groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "p8-pairs")
    ids = pairs.select("doc_id").distinct()
    texts = documents.select("doc_id", "text").join(F.broadcast(ids) if small(ids) else ids, "doc_id", "left_semi")
    joined = pairs.join(texts, "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")
    return joined.where(_confirm("text", "item", "spans")).select("doc_id", "item_id").distinct()


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds 16 or more words of the item in a row, at most one word in six edited.

    Null texts and ids hold nothing; items under 16 words cannot leak; texts stored twice are reported for each doc_id.
    """
    held = _small_items(items)
    return _shuffled(documents, items) if held is None else _scanned(documents, held)


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents hold each item; items that leak nowhere have 0."""
    n = found(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id").distinct().join(n, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
