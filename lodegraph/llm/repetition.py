"""Repetition inside a single document.

Two measures. ``repeated_share`` counts the windows of consecutive words that equal an earlier window
of the same document; it decides which documents repeat themselves. ``divergence`` compares a
document's histograms of character classes and common words with references of its language by
Jensen-Shannon distance. The distance cannot replace the share: writing a text twice leaves its
histograms, and so its distance, as they were, while half of its windows become repeats.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.words import blocks, words
from lodegraph.runtime import cut

WINDOW = 6
MIN_WORDS = 30
MIN_SHARE = 0.3

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """A hash of the window that starts at each word (wrapping 64-bit arithmetic)."""
    n = len(codes) - window + 1
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ codes[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _repeats(found: list[str], begin: np.ndarray, window: int, least: float, min_words: int) -> np.ndarray:
    """Of each document, the number of windows that equal an earlier one.

    Equal windows have equal hashes, so the hashes never count too few; where they count a share of at
    least ``least``, words are compared.
    """
    n_docs = len(begin) - 1
    size = np.diff(begin)
    windows = np.maximum(size - window + 1, 0)
    repeats = np.zeros(n_docs, np.int64)
    if not windows.any():
        return repeats
    codes = np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)
    hashes = _window_hashes(codes, window)
    at = np.repeat(np.arange(n_docs), size)[: len(hashes)]
    inside = np.arange(len(hashes)) + window <= begin[at + 1]
    bits = np.uint64(max(1, int(n_docs - 1).bit_length()))
    keys = (hashes[inside] << bits) | at[inside].astype(np.uint64)
    keys.sort()
    twice = keys[1:][keys[1:] == keys[:-1]] & np.uint64((1 << int(bits)) - 1)
    guess = np.bincount(twice.astype(np.int64), minlength=n_docs)
    for i in np.flatnonzero((guess > 0) & (size >= min_words) & (guess >= least * windows)):
        w = found[begin[i] : begin[i + 1]]
        repeats[i] = windows[i] - len(set(zip(*(w[k:] for k in range(window)), strict=False)))
    return repeats


def repeated_share(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS, min_share: float = 0.0) -> DataFrame:
    """``(doc_id, n_words, n_windows, n_repeated, share)`` of each document with at least ``min_words`` words.

    ``share`` is the part of the windows of ``window`` words that equal an earlier window of the
    document; only documents with a share of at least ``min_share`` are returned (0: all of them).
    Documents are read where they are; nothing is shuffled, and whole texts are counted. Null, empty
    and blank texts have no words and give no row; so does a text shorter than a window. Rows that
    repeat a doc_id are measured each for itself; other columns are ignored.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, begin in blocks(batches):
            size = np.diff(begin)
            windows = np.maximum(size - window + 1, 0)
            n = _repeats(found, begin, window, min_share, min_words)
            keep = np.flatnonzero((size >= min_words) & (windows > 0) & (n >= min_share * windows))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep)), *(pa.array(x[keep], pa.int64()) for x in (size, windows, n)), pa.array(n[keep] / windows[keep])],
                names=["doc_id", "n_words", "n_windows", "n_repeated", "share"],
            )

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(measure, "doc_id long, n_words long, n_windows long, n_repeated long, share double")


def repeating_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, share)``: documents of at least 30 words with at least 30 % repeated 6-word windows."""
    return repeated_share(documents, min_share=MIN_SHARE).select("doc_id", "share")


# --- divergence from language references ---------------------------------------------------------

#: Character classes of the first histogram.
CLASSES = ("lower", "upper", "digit", "cjk", "space", "mark", "other")
#: Common words per language in the second histogram; all other words share one cell.
COMMON_WORDS = 200
#: Languages whose references a task holds at once.
LANGUAGES = 1_000


def _class_counts(text: str) -> list[int]:
    n = [0] * len(CLASSES)
    for c, k in Counter(text).items():
        if "一" <= c <= "鿿":
            i = 3
        elif c.islower():
            i = 0
        elif c.isupper():
            i = 1
        elif c.isdigit():
            i = 2
        elif c.isspace():
            i = 4
        elif not c.isalnum():
            i = 5
        else:
            i = 6
        n[i] += k
    return n


def _js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms; 0 if both are empty, 1 if one is."""
    if not p.sum() or not q.sum():
        return float(bool(p.sum()) != bool(q.sum()))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    total = 0.0
    for x in (p, q):
        on = x > 0
        total += float((x[on] * np.log2(x[on] / m[on])).sum())
    return float(np.sqrt(max(total / 2, 0.0)))


def language_references(documents: DataFrame, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Histograms over all documents of a language: ``(lang, class, n)`` and ``(lang, word, n)``.

    Counts are made per run of documents and then added up, so a language that holds a third of the
    documents is no hot key. The second keeps each language's ``COMMON_WORDS`` most frequent words
    (ties by word). A null lang is a language of its own, written ``""``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())],
                names=["lang", "kind", "item", "n"],
            )

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, k in Counter(words(t)).items():
                    total[name, "word", w] += k
                for c, k in zip(CLASSES, _class_counts(t or ""), strict=True):
                    total[name, "class", c] += k
            if len(total) > 200_000:
                yield out()
                total.clear()
        yield out()

    rows = documents.select(F.coalesce(lang, F.lit("")).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window as W

    by = W.partitionBy("lang").orderBy(F.desc("n"), "item")
    common = counts.where("kind = 'word'").withColumn("place", F.row_number().over(by)).where(F.col("place") <= COMMON_WORDS)
    return (
        counts.where("kind = 'class'").select("lang", F.col("item").alias("class"), "n"),
        common.select("lang", F.col("item").alias("word"), "n"),
    )


def divergence(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, languages: int = LANGUAGES) -> DataFrame:
    """``(doc_id, lang, class_distance, word_distance)`` of each document with at least ``min_words`` words.

    The references are made from all documents; of each language they are ``COMMON_WORDS`` words and
    seven classes. They go to the tasks in blocks of about ``LANGUAGES`` languages, each of which measures
    the documents of its own. Shorter documents give no row: their histograms say nothing.
    """
    classes, common = language_references(documents, lang, text)
    made = classes.select("lang", F.lit("class").alias("kind"), F.col("class").alias("item"), "n").unionByName(
        common.select("lang", F.lit("word").alias("kind"), F.col("word").alias("item"), "n")
    )
    made = cut(made)
    parts = max(1, math.ceil(made.select("lang").distinct().count() / languages))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), F.col(text).alias("text"))
    block = lambda k: F.pmod(F.xxhash64("lang"), F.lit(parts)) == k
    out = [rows.where(block(k)).mapInArrow(_measure(made.where(block(k)).collect(), min_words), "doc_id long, lang string, class_distance double, word_distance double") for k in range(parts)]
    return reduce(DataFrame.unionByName, out)


def _measure(held: list, min_words: int):
    """Distances of documents to the references in ``held``."""
    by_lang: dict[str, dict[str, dict[str, int]]] = {}
    for r in held:
        by_lang.setdefault(r["lang"], {"word": {}, "class": {}})[r["kind"]][r["item"]] = r["n"]
    ref = {
        name: (np.array([x["class"].get(c, 0) for c in CLASSES], float), {w: i for i, w in enumerate(x["word"])}, np.array(list(x["word"].values()), float))
        for name, x in by_lang.items()
    }

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, name, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w = words(t)
                if len(w) < min_words:
                    continue
                shape, place, counts = ref[name]
                own = np.zeros(len(counts))
                for x, k in Counter(w).items():
                    if x in place:
                        own[place[x]] = k
                out.append((i, name, _js_distance(np.array(_class_counts(t), float), shape), _js_distance(own, counts)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                names=["doc_id", "lang", "class_distance", "word_distance"],
            )

    return measure
