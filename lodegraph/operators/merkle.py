"""Merkle trees over hash ranges of a key.

A key falls into one of ``2 ** (bits * depth)`` leaves by the leading bits of its 64-bit hash, so a
leaf is a range of hashes. A leaf's digest combines the digests of its rows, an inner node's digest
combines hashes of the leaves under it. Two trees of the same shape
are compared from the root down, and only children of differing nodes are looked at.

Row digests are 128 bits wide (two 64-bit hashes); rows of one leaf are combined by exclusive or
and a count, which is order-free and aggregates before the shuffle. A tree holds one row per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
LEAF_ROWS = 64


def plan_shape(rows: int, leaf_rows: int = LEAF_ROWS, most_bits: int = 6) -> tuple[int, int]:
    """Levels under the root, and bits a level, that give leaves of about ``leaf_rows`` rows."""
    total = max(1, min(48, math.ceil(math.log2(max(2, rows / leaf_rows)))))
    depth = math.ceil(total / most_bits)
    return depth, math.ceil(total / depth)


def leaf_of(key: Column, depth: int, bits: int = BITS) -> Column:
    """Leaf number of a key: the leading ``bits * depth`` bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits * depth)


def row_digest(*values: Column, salt: int = 0) -> Column:
    """64-bit digest of a row; a null differs from every value and from a null elsewhere."""
    parts: list[Column] = [F.lit(salt)]
    for v in values:
        parts += [v, v.isNull()]
    return F.xxhash64(*parts)


def leaves(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Leaf digests of ``rows(scope..., leaf, d1, d2)``."""
    return rows.groupBy(*(scope or []), "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")
    )


def tree(leaf: DataFrame, depth: int, scope: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """All levels over leaf digests: ``(scope..., level, node, n, d1, d2)``; level ``depth`` is the leaves.

    A leaf's number and digests are hashed, and a node's digest combines these hashes of all leaves
    under it, so all levels come from one aggregation that starts before its shuffle.
    """
    scope = scope or []
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    hashed = [F.xxhash64(F.lit(k), "leaf", "n", "d1", "d2").alias(f"d{k}") for k in (1, 2)]
    up = leaf.select(*scope, "leaf", "n", *hashed, level)
    node = F.expr(f"shiftright(leaf, {bits} * ({depth} - level))").alias("node")
    return up.groupBy(*scope, "level", node).agg(F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))


def differing_leaves(current: DataFrame, saved: DataFrame, depth: int, scope: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """``(scope..., leaf)`` of the leaves whose digests differ, found from the root down."""
    scope = scope or []
    on = [*scope, "node"]
    front: DataFrame | None = None
    for d in range(depth + 1):
        pair = []
        for side, df in (("a", current), ("b", saved)):
            at = df.where(F.col("level") == d).select(*on, *(F.col(c).alias(f"{side}_{c}") for c in ("n", "d1", "d2")))
            if front is not None:
                at = at.withColumn("up", F.shiftright("node", bits)).join(front, [*scope, "up"], "left_semi").drop("up")
            pair.append(at)
        same = F.lit(True)
        for c in ("n", "d1", "d2"):
            same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        differ = pair[0].join(pair[1], on, "full").where(~same).select(*on)
        front = differ.withColumnRenamed("node", "up")
    return front.withColumnRenamed("up", "leaf")
