"""Per-key counts that do not depend on how rows are spread over keys."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import cut

#: Rows whose keys are encoded and counted at once; bounds the accumulator of a task.
BLOCK_ROWS = 1 << 20


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary-encode the key of each block of rows and count codes in one dense array."""
    def block(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(part)
        label, target = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode"), rows.column(1).combine_chunks().dictionary_encode()
        if isinstance(label, pa.ChunkedArray):
            label, target = label.combine_chunks(), target.combine_chunks()
        a, b = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (label, target))
        codes = a * len(target.dictionary) + b
        width = len(label.dictionary) * len(target.dictionary)
        if width > 4 * len(codes) + 1024:  # a sparse block: encode the pairs, so that the array stays dense
            pairs, codes = np.unique(codes, return_inverse=True)
        else:
            pairs = np.arange(width)
        counts = np.bincount(codes, minlength=len(pairs))
        seen = np.flatnonzero(counts)
        at, to = np.divmod(pairs[seen], len(target.dictionary))
        return pa.RecordBatch.from_arrays(
            [label.dictionary.take(pa.array(at)), target.dictionary.take(pa.array(to)), pa.array(counts[seen], pa.int64())],
            names=["label", "target", "n"],
        )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BLOCK_ROWS:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def key_counts(rows: DataFrame, label: str, target: str, splits: int | None = None) -> DataFrame:
    """``(label, target, n)``: rows per key, made from equal splits of the rows.

    Each split encodes its keys by a dictionary and counts them in a dense array (``bincount``); the
    arrays are added up by a distributed sum, to which a split gives one row per key at most. A key
    that holds a third of the rows costs no more than any other. ``splits`` deals the rows out anew;
    without it the rows' present partitions are used. A null label is a label of its own; rows with a
    null target are left out; an empty table gives no rows.
    """
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(target).cast("long").alias("target")).where("target IS NOT NULL")
    if splits:
        rows = rows.repartition(splits)
    part = rows.mapInArrow(_accumulate, "label string, target long, n long")
    return part.groupBy("label", "target").agg(F.sum("n").alias("n"))


def distinct_edges(edge: DataFrame) -> DataFrame:
    """Edges with a target, once per (from_id, to_id, relation_type, call_line with null as 0)."""
    line = F.coalesce("call_line", F.lit(0))
    return edge.where("to_id > 0").select("from_id", "to_id", "relation_type", line.alias("call_line")).distinct()


def target_counts(edge: DataFrame) -> DataFrame:
    """``(relation_type, to_id, n_edges)`` over distinct edges.

    ``distinct`` partitions by all four columns, so no key of the result is hot in it, and leaves the
    equal splits that the counts are made from.
    """
    counts = key_counts(distinct_edges(edge), "relation_type", "to_id")
    return counts.select(F.col("label").alias("relation_type"), F.col("target").alias("to_id"), F.col("n").alias("n_edges"))


def heavy_targets(edge: DataFrame, share: float = 0.005) -> DataFrame:
    """``(relation_type, to_id, n_edges)`` with at least ``share`` of all distinct edges."""
    counts = cut(target_counts(edge))  # one row per key, used twice
    total = counts.agg(F.sum("n_edges").cast("decimal(20,0)")).scalar()
    return counts.where(F.col("n_edges") >= F.lit(Decimal(str(share))) * total)
