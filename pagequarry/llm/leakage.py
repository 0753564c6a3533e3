"""Evaluation texts inside a training corpus.

The n-grams of words of the evaluation side make a hash set that every task gets, as a Bloom filter of 64 bits a
gram and at most `MAX_FILTER_BYTES`. The corpus is read once, in place: the windows of each document are looked up in
the set, and only those it may hold, with their words, meet the n-grams of the items in a join that compares the words
themselves. A larger evaluation side makes the filter let more through, and nothing else.

Word = longest run of letters or digits in the lower-cased text.

Defined results: null, empty and short texts leak nothing; repeated rows give one row; items shorter than n words
cannot leak; ids may be null and then leak as one document or item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, small_side

N_WORDS = 12
MAX_FILTER_BYTES = 1 << 26
_CACHE_WORDS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Windows:
    """Hashes of all windows of n words of a text; word hashes are remembered."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        m = len(tokens) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.array([known[w] for w in tokens], np.uint64)
        h = np.zeros(m, np.uint64)
        for k in range(self.n):
            h = h * _BASE + ids[k : k + m]
            h ^= h >> np.uint64(29)
        return h * _BASE


class GramFilter:
    """A Bloom filter with two probes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def empty(n_grams: int) -> np.ndarray:
        size = 1 << 10
        while size < 8 * n_grams and size < MAX_FILTER_BYTES:
            size *= 2
        return np.zeros(size, np.uint8)

    def _probes(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for h in (hashes & self.mask, (hashes >> np.uint64(32)) * _BASE >> np.uint64(20) & self.mask):
            yield (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._probes(hashes):
            np.bitwise_or.at(self.bits, at, bit)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at, bit in self._probes(hashes):
            out &= (self.bits[at] & bit) != 0
        return out


def item_grams(side: DataFrame, n: int) -> DataFrame:
    """item_id, hash, gram of side(item_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(n)
        for batch in batches:
            rows = []
            for i, t in zip(batch["item_id"], batch["text"]):
                tokens = words(t)
                rows += [(i, h, " ".join(tokens[k : k + n])) for k, h in enumerate(windows(tokens).view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item_id", "hash", "gram"])

    kind = side.schema["item_id"].dataType.simpleString()
    return side.filter("text is not null").mapInPandas(run, f"item_id {kind}, hash long, gram string").distinct()


def gram_filter(grams: DataFrame) -> GramFilter:
    """Tasks fill filters of their own, the driver joins them one after the other."""
    start = GramFilter.empty(grams.count())
    size = len(start)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = GramFilter(np.zeros(size, np.uint8))
        for batch in batches:
            mine.add(batch["hash"].to_numpy(np.int64).view(np.uint64))
        yield pd.DataFrame({"bits": [mine.bits.tobytes()]})

    for row in grams.select("hash").coalesce(16).mapInPandas(fill, "bits binary").toLocalIterator():
        start |= np.frombuffer(row["bits"], np.uint8)
    return GramFilter(start)


def leaked_windows(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = N_WORDS) -> DataFrame:
    """doc_id, item_id, k: the windows of n words, k the place of their first word, that document and item share."""
    side = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    grams = materialize(item_grams(side, n), "item-grams")
    shared = docs.sparkSession.sparkContext.broadcast(gram_filter(grams).bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, known = Windows(n), GramFilter(shared.value)
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"]):
                tokens = words(t)
                hashes = windows(tokens)
                for k in np.flatnonzero(known.may_hold(hashes)).tolist():
                    rows.append((d, k, int(hashes[k : k + 1].view(np.int64)[0]), " ".join(tokens[k : k + n])))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "hash", "gram"])

    kind = docs.schema[doc_id].dataType.simpleString()
    hits = corpus.mapInPandas(run, f"doc_id {kind}, k int, hash long, gram string")
    return hits.join(small_side(grams), ["hash", "gram"]).select("doc_id", "item_id", "k").distinct()


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = N_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, last_word, n_windows: where a document holds words of an item.

    first_word..last_word spans all its hits of that item; n_windows counts them. `leaked_runs` has them apart.
    """
    windows = leaked_windows(docs, items, doc_id, text, item_id, item_text, n)
    return windows.groupBy("doc_id", "item_id").agg(F.min("k").alias("first_word"), (F.max("k") + n - 1).cast("int").alias("last_word"), F.count("*").cast("int").alias("n_windows"))


def leaked_runs(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = N_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, last_word: each passage of its own, i.e. run of windows that follow one another."""
    windows = leaked_windows(docs, items, doc_id, text, item_id, item_text, n)
    island = F.col("k") - F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy("k"))
    return windows.withColumn("island", island).groupBy("doc_id", "item_id", "island").agg(F.min("k").alias("first_word"), (F.max("k") + n - 1).cast("int").alias("last_word")).drop("island")


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = N_WORDS) -> DataFrame:
    """docs without the documents that hold n consecutive words of an item; all columns kept."""
    found = leaked_windows(docs, items, doc_id, text, item_id, item_text, n).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(small_side(materialize(found, "leaked")), F.col(doc_id).eqNullSafe(F.col("__leaked")), "left_anti")


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in the text as it stands."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    at = [k for k, c in enumerate(text) for _ in c.lower()]  # some characters get longer
    at += [len(text)] * (len(low) + 1 - len(at))
    return [(at[m.start()], at[m.end() - 1] + 1) for m in WORD.finditer(low)]


def cut_windows(text: str, starts: list[int], n: int = N_WORDS) -> str:
    """text without the words of the windows, and what stands between them."""
    places = _places(text)
    out, done, last = [], 0, -1
    for k in sorted(starts):
        end = min(k + n, len(places))
        if k > last:
            out.append(text[done : places[k][0]])
        done, last = places[end - 1][1], end
    return "".join([*out, text[done:]])


def without_leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = N_WORDS, out_col: str = "clean_text") -> DataFrame:
    """docs with out_col: the text without its leaked passages; all rows and other columns kept. Only documents with a
    leak are cut; the others are not moved."""
    windows = leaked_windows(docs, items, doc_id, text, item_id, item_text, n)
    starts = materialize(windows.groupBy("doc_id").agg(F.sort_array(F.collect_set("k")).alias("__starts")).withColumnRenamed("doc_id", "__leaked"), "leaked-windows")
    joined = docs.join(small_side(starts), F.col(doc_id).eqNullSafe(F.col("__leaked")), "left").drop("__leaked")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or p is None else cut_windows(t, list(p), n) for t, p in zip(texts, places)], dtype=object)

    return joined.withColumn(out_col, cut(F.col(text), F.col("__starts"))).drop("__starts")
