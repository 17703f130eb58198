"""Traversal: oriented arcs, multi-source closures, simple paths, depth-first order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.runtime import cut

#: Relations that lead from the lower to the upper record: walking "outgoing" goes against them.
FLIPPED = ("inherits_public", "inherits_protected", "inherits_private", "belongs_to")


def first_by(df: DataFrame, keys: list[str], *order: Column, most: int = 1) -> DataFrame:
    """The first row of each key under an order (tiers, then a tie-break), or the first ``most``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def orient(edges: DataFrame, direction: str = "outgoing", relations: list[str] | None = None, logical: bool = True) -> DataFrame:
    """``(src, dst, relation_type)`` arcs to walk along.

    ``direction`` is outgoing, incoming or both. With ``logical``, outgoing leads from a class to its
    children and members, against the stored direction of those relations. Inputs that are none of the
    three directions raise.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction: {direction}")
    arcs = edges.where(F.col("relation_type").isin(relations)) if relations else edges  # P-13
    turn = F.col("relation_type").isin(*FLIPPED) if logical else F.lit(False)
    a, b = F.when(turn, F.col("dst")).otherwise(F.col("src")), F.when(turn, F.col("src")).otherwise(F.col("dst"))
    out = arcs.select(a.alias("src"), b.alias("dst"), "relation_type")
    if direction == "outgoing":
        return out
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation_type")
    return back if direction == "incoming" else out.unionByName(back)


#: Arcs that every task may hold at most, so that it walks from its share of the seeds by itself.
HELD_ARCS = 200_000
#: Tasks that share the seeds then, and seeds that walk together in one.
SHARES, TOGETHER = 12, 512


def _walk(max_depth: int):
    """Breadth-first walks of some seeds over arcs that are at hand: ``(seed, node, depth)``, a level of all of them at a time."""

    def run(seeds: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        columns = ["seed", "node", "depth"]
        if not len(seeds):
            return pd.DataFrame({"seed": seeds["seed"], "node": seeds["node"], "depth": np.empty(0, np.int32)})
        names, codes = np.unique(np.concatenate([x.to_numpy() for x in (seeds["node"], arcs["src"], arcs["dst"])]), return_inverse=True)
        origin, seed = np.unique(seeds["seed"].to_numpy(), return_inverse=True)
        n, k, m = len(names), len(seeds), len(arcs)
        start, src, dst = codes[:k], codes[k : k + m], codes[k + m :]
        order = np.argsort(src, kind="stable")
        dst = dst[order]
        first = np.searchsorted(src[order], np.arange(n + 1))
        out = []
        for low in range(0, len(origin), TOGETHER):
            mine = (seed >= low) & (seed < low + TOGETHER)
            front = np.unique(seed[mine] * n + start[mine])
            seen, depth = front, 0
            while len(front):
                out.append(pd.DataFrame({"seed": origin[front // n], "node": names[front % n], "depth": np.full(len(front), depth, np.int32)}))
                if max_depth and depth >= max_depth:
                    break
                at = front % n
                count = first[at + 1] - first[at]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at], count)
                new = np.unique(np.repeat(front // n, count) * n + dst[place])
                known = np.searchsorted(seen, new)
                front = new[(known == len(seen)) | (seen[np.minimum(known, len(seen) - 1)] != new)]
                seen = np.union1d(seen, front)
                depth += 1
        return pd.concat(out)[columns]

    return run


def _walk_shares(seeds: DataFrame, arcs: DataFrame, max_depth: int) -> DataFrame:
    """``closure`` where every task holds all arcs; nothing passes the driver."""
    share = F.pmod(F.xxhash64("seed"), F.lit(SHARES))
    every = arcs.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<long>")))
    types = {f.name: f.dataType.simpleString() for f in seeds.schema}
    walked = seeds.withColumn("share", share).groupBy("share").cogroup(every.groupBy("share"))
    return walked.applyInPandas(_walk(max_depth), f"seed {types['seed']}, node {types['node']}, depth int")


def closure(seeds: DataFrame, arcs: DataFrame, max_depth: int = 0, include_seeds: bool = True, held: int = HELD_ARCS) -> DataFrame:
    """``(seed, node, depth)``: nodes reached from each seed, with the fewest steps.

    ``seeds(seed, node)`` start at depth 0 (one origin may have several nodes); ``arcs(src, dst)``. All seeds advance
    together, one join a step, and only newly reached pairs go on, so cycles end and the cost follows
    the result. Up to ``held`` arcs, every task holds all of them and walks from its share of the seeds
    in one job. ``max_depth`` 0 means to the fixpoint. Nulls are no nodes.
    """
    arcs = cut(arcs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    front = seeds.select("seed", "node").where("node IS NOT NULL AND seed IS NOT NULL").distinct()
    if arcs.limit(held + 1).count() <= held:
        seen = _walk_shares(front, arcs, max_depth)
        return seen if include_seeds else seen.where("depth > 0")
    front = cut(front.withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while not front.isEmpty() and (not max_depth or depth < max_depth):
        depth += 1
        step = front.join(arcs, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen if include_seeds else seen.where("depth > 0")


def all_pairs(arcs: DataFrame, held: int = HELD_ARCS) -> DataFrame:
    """``(seed, node, depth)``: nodes reached from every node but itself, with the fewest steps.

    Pairs up to 2d steps apart come from those up to d by one join through the nodes at exactly d
    steps, so it takes as many joins as the logarithm of the longest distance. Up to ``held`` arcs, every
    task holds all of them, as in ``closure``.
    """
    near = cut(arcs.select(F.col("src").alias("seed"), F.col("dst").alias("node")).where("seed <> node").distinct())
    if near.limit(held + 1).count() <= held:
        start = near.select("seed", F.col("seed").alias("node")).distinct()
        return _walk_shares(start, near.select(F.col("seed").alias("src"), F.col("node").alias("dst")), 0).where("depth > 0")
    pairs = near.withColumn("depth", F.lit(1))
    reach = 1
    while True:
        far = pairs.where(F.col("depth") == reach).select("seed", F.col("node").alias("middle"))
        if far.isEmpty():
            return pairs
        step = pairs.select(F.col("seed").alias("middle"), "node", F.col("depth").alias("more"))
        new = far.join(step, "middle").where("seed <> node").groupBy("seed", "node").agg((F.min("more") + reach).alias("depth"))
        pairs = cut(pairs.unionByName(new.join(pairs, ["seed", "node"], "left_anti")))
        reach *= 2


def simple_paths(seeds: DataFrame, arcs: DataFrame, max_depth: int) -> DataFrame:
    """``(seed, node, path, depth)``: every path without a repeated node, up to ``max_depth`` steps."""
    arcs = cut(arcs.select("src", "dst").distinct())
    front = seeds.select("seed", "node", F.array("node").alias("path"), F.lit(0).alias("depth"))
    out = front
    for depth in range(1, max_depth + 1):
        grown = front.join(arcs, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = cut(grown.select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def traverse(seeds: DataFrame, arcs: DataFrame, max_depth: int, max_results: int) -> tuple[DataFrame, bool]:
    """Breadth-first traversal with a limit: ``(node, depth, parent, relation_type)`` and whether it was cut off.

    ``parent`` is the smallest node of the level above that leads there. As a report of the first
    ``max_results`` nodes by (depth, node), it counts as cut off also when there are exactly so many.
    """
    reached = cut(closure(seeds.select(F.lit(0).alias("seed"), "node"), arcs, max_depth).groupBy("node").agg(F.min("depth").alias("depth")))
    up = reached.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    into = arcs.join(up, "src").select(F.col("dst").alias("node"), "depth", F.col("src").alias("parent"), "relation_type")
    best = into.groupBy("node", "depth").agg(F.min(F.struct("parent", "relation_type")).alias("m"))
    full = reached.join(best, ["node", "depth"], "left").select("node", "depth", "m.parent", "m.relation_type")
    top = full.orderBy("depth", "node").limit(max_results)
    return top, top.count() >= max_results


def depth_first(start: int, arcs: DataFrame, max_depth: int, max_results: int = 10_000) -> DataFrame:
    """``(place, node, depth)``: depth-first order from one node, smallest neighbour first.

    The ball of ``max_depth`` steps is found by ``closure``; ordering it is sequential, so it must
    have at most ``max_results`` nodes (else this raises), and one task walks it.
    """
    spark = arcs.sparkSession
    ball = cut(closure(spark.createDataFrame([(0, start)], "seed long, node long"), arcs, max_depth))
    if ball.limit(max_results + 1).count() > max_results:
        raise ValueError(f"more than {max_results} nodes within {max_depth} steps")
    inside = ball.select(F.col("node").alias("src"))
    local = arcs.select("src", "dst").distinct().join(inside, "src", "left_semi").repartition(1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, list[int]] = {}
        for b in batches:
            for s, t in zip(b["src"], b["dst"], strict=True):
                out.setdefault(s, []).append(t)
        order, seen, stack = [], set(), [(start, 0)]
        while stack:
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            order.append((len(order), node, depth))
            if depth < max_depth:
                stack += [(t, depth + 1) for t in sorted(out.get(node, ()), reverse=True) if t not in seen]
        yield pd.DataFrame(order, columns=["place", "node", "depth"])

    marker = spark.createDataFrame([(start, start)], "src long, dst long").limit(0)
    return local.unionByName(marker).mapInPandas(walk, "place long, node long, depth long")
