"""Evaluation texts leaking into training text.

1. *Candidates.* The four-word sequences of all test items set bits in a bitmap of bounded size. Documents
   are read once, whole, where they are; only runs of words whose four-word sequences all have their bit
   are kept. Equal words have equal bits, so no match is lost, and nothing but the runs is moved.
2. *Shards.* Runs are gathered in shards of about ``SHARD_WORDS`` words. A shard's suffix array has all of
   its suffixes in order of all their words (prefix doubling). It is built once and kept in the shared
   checkpoint folder.
3. *Search.* Items are laid in blocks of about ``BLOCK_WORDS`` words. Each block meets each shard in one
   task, where every suffix of every item is binary-searched in the suffix array, word by word; hits that
   continue each other give the longest verbatim matches and their places.

Items go from executors to executors; the driver holds only the bitmap (128 MB at most) and a few numbers.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.words import blocks
from lodegraph.runtime import cut

MIN_WORDS = 13
#: Words of the sequences that candidates are found by.
GRAM = 4
#: Words of a shard of candidate runs, and of a block of items, roughly; a longer run or item is whole in one.
SHARD_WORDS, BLOCK_WORDS = 1_000_000, 500_000
#: Bits of the bitmap as powers of two: 16 for each sequence, within these bounds. A fuller bitmap lets
#: more candidates pass and changes no result.
LEAST_BITS, MOST_BITS = 16, 30
#: Words whose hashes a task remembers.
_REMEMBERED = 1 << 20

SCHEMA = "doc_id long, item_id long, n_words long, at_word long"


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _slots(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The bit of the ``k`` words from each place on, but for the last k - 1."""
    n = max(len(h) - k + 1, 0)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
        g ^= g >> np.uint64(29)
    return (g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


def _items(heldout: DataFrame) -> DataFrame:
    """``(item_id, words, n)``: the words of each item's texts, joined by blanks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, begin in blocks(batches):
            joined = [" ".join(found[a:b]) for a, b in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(joined, pa.string()), pa.array(np.diff(begin), pa.int64())], names=["item_id", "words", "n"])

    rows = heldout.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return cut(rows.mapInArrow(split, "item_id long, words string, n long").where("n > 0").distinct())


def _bitmap(items: DataFrame, gram: int, bits: int) -> np.ndarray:
    """The bits of all sequences of all items, made in 64 slices."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.split(" ")
                got = np.unique(_slots(hashes.of(words), min(gram, len(words)), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got)], names=["slot"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["slot"].to_numpy()
        held = np.zeros(1 << (bits - 6), bool)
        held[at & ((1 << (bits - 6)) - 1)] = True
        return pd.DataFrame({"slice": [at[0] >> (bits - 6)], "held": [np.packbits(held, bitorder="little").tobytes()]})

    found = items.select("words").mapInArrow(slots, "slot long").distinct()
    slices = found.groupBy(F.shiftright("slot", bits - 6)).applyInPandas(fill, "slice long, held binary").collect()  # 64 rows at most
    out = np.zeros((64, 1 << (bits - 9)), np.uint8)
    for r in slices:
        out[r["slice"]] = np.frombuffer(r["held"], np.uint8)
    return out.ravel()


def _runs(documents: DataFrame, bitmap: np.ndarray, bits: int, least: dict[int, int]) -> DataFrame:
    """``(doc_id, at, words)``: runs of words of documents that can hold an item's; ``least`` gives the words a run needs by those of its sequences."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for ids, found, begin in blocks(batches):
            h = hashes.of(found)
            size = np.diff(begin)
            end = np.repeat(begin[1:], size)
            at, to = [], []
            for k, need in least.items():
                slot = _slots(h, k, bits)
                n = len(slot)
                hit = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                hit &= np.arange(n) + k <= end[:n]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                a, b = edge[::2], edge[1::2] + k - 1
                keep = b - a >= need
                at.append(a[keep])
                to.append(b[keep])
            a, b = np.concatenate(at), np.concatenate(to)
            doc = np.searchsorted(begin, a, "right") - 1
            words = [" ".join(found[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(a - begin[doc], pa.int64()), pa.array(words, pa.string())], names=["doc_id", "at", "words"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return cut(rows.mapInArrow(search, "doc_id long, at long, words string").distinct())


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """All suffixes of ``codes`` in order, by prefix doubling; codes that close a text must occur once each."""
    _, rank = np.unique(codes, return_inverse=True)
    rank, n, step = rank.astype(np.int64), len(codes), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Shard:
    """Runs of words of documents with the array of all their suffixes."""

    def __init__(self, runs: list[list[str]]):
        self.vocabulary = sorted({w for r in runs for w in r})
        code = {w: k for k, w in enumerate(self.vocabulary, len(runs))}
        # a run is closed by its own number, which is no word's code, so no match goes beyond it
        self.codes = np.array([c for k, r in enumerate(runs) for c in (*(code[w] for w in r), k)], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in runs])])
        order = suffix_array(self.codes)
        self.suffixes = order[self.codes[order] >= len(runs)]

    def ranges(self, wanted: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``wanted``, the range of suffixes that begin with its first ``need`` words.

        All rows are searched at once, and a word narrows a row's range further; rows whose range is
        empty are searched no more.
        """
        padded = np.append(self.codes, -1)
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.suffixes), np.int64)
        for d in range(wanted.shape[1] if len(wanted) else 0):
            live = np.flatnonzero((need > d) & (low < high))
            if not len(live):
                break
            column = padded[np.minimum(self.suffixes + d, len(self.codes))]
            low[live], high[live] = (self._bound(column, low[live], high[live], wanted[live, d], right) for right in (False, True))
        return low, high

    @staticmethod
    def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = column[np.where(open_, mid, 0)]
            less = open_ & ((at <= want) if right else (at < want))
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return low

    def search(self, items: list[list[str]], depth: int) -> Iterator[tuple[np.ndarray, ...]]:
        """``(run, item, words, place)``: the longest match of each item in each run, where it has ``depth`` words or all of the item's."""
        code = {w: k for k, w in enumerate(self.vocabulary, int(self.codes.max()) + 1 - len(self.vocabulary))} if self.vocabulary else {}
        rows, item, at, need = [], [], [], []
        for n, words in enumerate(items):
            ids = np.array([code.get(w, -1) for w in words], np.int64)
            m = min(depth, len(ids))
            if m < 1:
                continue
            view = np.lib.stride_tricks.sliding_window_view(ids, m)
            good = np.flatnonzero((view >= 0).all(axis=1))
            wide = np.zeros((len(good), depth), np.int64)
            wide[:, :m] = view[good]
            rows.append(wide)
            item.append(np.full(len(good), n))
            at.append(good)
            need.append(np.full(len(good), m))
        if not rows:
            return
        wanted, item, at, need = (np.concatenate(x) for x in (rows, item, at, need))
        low, high = self.ranges(wanted, need)
        hits = np.maximum(high - low, 0)
        # all hits of some items at once, about four million
        chunk = np.cumsum(hits) // (4 << 20)
        first_of_item = np.concatenate([[True], item[1:] != item[:-1]])
        group = np.maximum.accumulate(np.where(first_of_item, chunk, 0))
        for g in np.unique(group[hits > 0]):
            mine = np.flatnonzero((group == g) & (hits > 0))
            yield self._longest(*(x[mine] for x in (low, hits, item, at, need)))

    def _longest(self, low, hits, item, at, need) -> tuple[np.ndarray, ...]:
        query = np.repeat(np.arange(len(hits)), hits)
        pos = self.suffixes[np.arange(len(query)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)]
        run = np.searchsorted(self.begin, pos, "right") - 1
        item, at, need = item[query], at[query], need[query]
        # hits that continue each other lie on one diagonal, word by word
        order = np.lexsort((pos, pos - at, item, run))
        run, item, at, pos, need = (x[order] for x in (run, item, at, pos, need))
        new = np.ones(len(pos), bool)
        new[1:] = (run[1:] != run[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        words = np.diff(np.append(first, len(pos))) - 1 + need[first]
        run, item, at = run[first], item[first], pos[first]
        best = np.lexsort((at, -words, item, run))
        run, item, words, at = (x[best] for x in (run, item, words, at))
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != run[:-1]) | (item[1:] != item[:-1])
        return run[keep], item[keep], words[keep], (at - self.begin[run])[keep]


def _shards(runs: DataFrame, shard_words: int) -> tuple[DataFrame, int]:
    """``(shard, held)``: suffix arrays of all runs, kept, and their number."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard([w.split(" ") for w in rows["words"]])
        ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "held": [pickle.dumps((shard, ids, rows["at"].to_numpy(np.int64)), 5)]})

    total = runs.agg(F.sum(F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1)).first()[0] or 0
    n = max(1, math.ceil(total / shard_words))
    placed = runs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "at", "words"), F.lit(n)))
    return cut(placed.groupBy("shard").applyInPandas(build, "shard long, held binary")), n


def leaked_items(documents: DataFrame, heldout: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, n_words, at_word)``: documents that hold ``min_words`` consecutive words of an item.

    Of an item with fewer words, all of them in order. ``n_words`` is the longest verbatim match and
    ``at_word`` where it begins in the document (the first of several). Every document is read whole,
    once, however many items there are.

    Defined results: null, empty and blank texts hold nothing; items without words, or with a null
    id, are in no document; items of one id are one item, which leaks if any of its texts does, and
    rows of one doc_id are one document; no items or no documents give no rows.
    """
    items = _items(heldout)
    gram = min(GRAM, min_words)
    stats = items.groupBy(F.least("n", F.lit(gram)).cast("int").alias("k")).agg(F.sum("n").alias("words"), F.min(F.least("n", F.lit(min_words))).alias("need")).collect()  # GRAM rows at most
    if not stats:
        return items.select(F.lit(0).cast("long").alias("doc_id"), "item_id", "n", F.lit(0).cast("long").alias("at_word")).toDF("doc_id", "item_id", "n_words", "at_word").limit(0)
    total = sum(r["words"] for r in stats)
    bits = min(max(math.ceil(math.log2(16 * total)), LEAST_BITS), MOST_BITS)
    runs = _runs(documents, _bitmap(items, gram, bits), bits, {r["k"]: r["need"] for r in stats})
    shards, n_shards = _shards(runs, shard_words)
    n_blocks = max(1, math.ceil(total / block_words))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"doc_id": pd.array([], "Int64"), "item_id": np.array([], np.int64), "n_words": np.array([], np.int64), "at_word": np.array([], np.int64)})]
        ids = right["item_id"].to_numpy()
        words = [w.split(" ") for w in right["words"]]
        for held in left["held"]:
            shard, docs, at = pickle.loads(held)
            docs = pd.array(docs, "Int64")
            for run, item, n, place in shard.search(words, min_words):
                out.append(pd.DataFrame({"doc_id": docs[run], "item_id": ids[item], "n_words": n, "at_word": at[run] + place}))
        return pd.concat(out[1:] or out)

    number = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(name)
    left = shards.select("shard", "held", number(n_blocks, "block"))
    right = items.select("item_id", "words", F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)).alias("block"), number(n_shards, "shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, SCHEMA)
    best = F.max(F.struct("n_words", (-F.col("at_word")).alias("back"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_words", (-F.col("m.back")).alias("at_word"))


def clean_documents(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """``documents`` without those in ``leaks``; a document with a null id cannot be named and stays."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def leak_report(leaks: DataFrame, heldout: DataFrame) -> DataFrame:
    """Of each item: ``(item_id, n_documents, longest_match)``, with 0 where it doesn't leak."""
    per = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest_match"))
    items = heldout.select(F.col("item_id").cast("long").alias("item_id")).where("item_id IS NOT NULL").distinct()
    zero = F.lit(0).cast("long")
    return items.join(per, "item_id", "left").select("item_id", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("longest_match", zero).alias("longest_match"))
