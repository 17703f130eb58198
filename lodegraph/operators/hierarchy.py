"""Parent-child links to full hierarchies, and cycles of general graphs.

``resolve_forest`` handles links in which a child has one parent. Links are range-partitioned by
child; each partition contracts the parent chains it holds to fragment exits (the first node up the
chain whose link it does not hold). The exits and their own fragments form a smaller quotient
forest, which is solved the same way, over fewer partitions, until it fits one. A quotient that no
longer shrinks is solved by one task up to a bound, else by distributed pointer doubling. Then
fragments are expanded: roots, depths and paths come down from the exits, numbers of descendants go up
from the tops of fragments. No pairs of nodes are made.

``cyclic_groups`` handles graphs in which a child has many parents (includes) the same way: nodes that
cannot lie on a cycle are trimmed, cycles within partitions are contracted to one node each, and the
quotient graph is solved again, over fewer partitions, until one partition holds it; one that no longer
shrinks and is too large for a task is solved by distributed colouring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import all_pairs
from lodegraph.runtime import cut, lookup_join

#: Links that one task solves at most.
SOLVE_ROWS = 1_000_000
#: Links of a partition that contracts chains.
PART_ROWS = 50_000

FRAGMENT = "node long, exit long, steps long, low long, cyclic boolean"


def _at_hand(node: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The place of each parent among the sorted nodes, their number where it is not there."""
    n = len(node)
    at = np.searchsorted(node, parent)
    return np.where((at < n) & (node[np.minimum(at, n - 1)] == parent), at, n)


def _contract(node: np.ndarray, parent: np.ndarray, steps: np.ndarray, low: np.ndarray, path: list[str] | None = None) -> tuple:
    """Follow the links that are at hand, by pointer doubling.

    ``low`` is the smallest node a link stands for, ``path`` the nodes it stands for from the top down.
    Returns for each link its exit, the steps to it, the smallest node before it, whether it ends in a
    cycle (then the exit is the cycle's smallest node), and the path from below the exit if paths are given.
    """
    n = len(node)
    order = np.argsort(node, kind="stable")
    node, parent, steps, low = node[order], parent[order], steps[order], low[order]
    at = _at_hand(node, parent)
    jump, dist, least = np.append(at, n), np.append(steps, 0), np.append(low, np.iinfo(np.int64).max)
    hops = np.append(np.ones(n, np.int64), 0)
    out = np.append(parent, 0)
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        go = jump[:n] < n
        if not go.any():
            break
        to = jump[:n]
        out[:n] = np.where(go, out[to], out[:n])
        dist[:n] = np.where(go, np.minimum(dist[:n] + dist[to], 1 << 62), dist[:n])
        hops[:n] = np.where(go, np.minimum(hops[:n] + hops[to], 1 << 62), hops[:n])
        least[:n] = np.minimum(least[:n], least[to])
        jump[:n] = jump[to]
    cyclic = jump[:n] < n
    # the place a cyclic chain has come to lies on the cycle, and all of the cycle is ahead of it
    exit_ = np.where(cyclic, least[np.minimum(jump[:n], n)], out[:n])
    if path is None:
        return node, exit_, dist[:n], least[:n], cyclic
    held = [path[k] for k in order.tolist()]
    up = at.tolist()
    for k in np.argsort(hops[:n], kind="stable").tolist():
        if cyclic[k]:
            held[k] = ""
        elif up[k] < n:
            held[k] = f"{held[up[k]]}/{held[k]}"
    return node, exit_, dist[:n], least[:n], cyclic, held


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    columns = [rows.column(c).to_numpy() for c in ("node", "exit", "steps", "low")]
    paths = "path" in rows.column_names
    got = _contract(*columns, rows.column("path").to_pylist() if paths else None)
    names = ("node", "exit", "steps", "low", "cyclic", "path")
    yield from pa.table(dict(zip(names[: len(got)], got, strict=True))).to_batches(max_chunksize=100_000)


def _columns(links: DataFrame) -> list[str]:
    return [c for c in ("node", "exit", "steps", "low", "path") if c in links.columns]


def _fragments(links: DataFrame, rows: int, part_rows: int) -> DataFrame:
    """Contract the chains within each partition; ``links(node, exit, steps, low)`` has one row per node, and may have paths."""
    parts = max(1, math.ceil(rows / part_rows))
    placed = links.coalesce(1) if parts == 1 else links.repartitionByRange(parts, "node")
    columns = _columns(links)
    return placed.select(*columns).mapInArrow(_contract_batches, FRAGMENT + (", path string" if "path" in columns else ""))


def _below(top: str, own: str) -> Column:
    """A path below another, which may be none."""
    return F.concat_ws("/", F.nullif(F.col(top), F.lit("")), F.col(own))


def _double(links: DataFrame, rows: int) -> DataFrame:
    """Solve links by pointer doubling over the cluster; for quotients that one task cannot hold."""
    columns = _columns(links)
    paths = ["path"] if "path" in columns else []
    state = links.select(*columns)
    for _ in range(math.ceil(math.log2(rows + 1)) + 1):
        ahead = state.select(F.col("node").alias("exit"), F.col("exit").alias("next"), F.col("steps").alias("more"), F.col("low").alias("lower"), *(F.col(c).alias("above") for c in paths))
        joined = lookup_join(state, ahead, "exit")
        state = cut(
            joined.select(
                "node",
                F.coalesce("next", "exit").alias("exit"),
                F.least(F.col("steps") + F.coalesce("more", F.lit(0)), F.lit(1 << 61)).alias("steps"),
                F.least("low", F.coalesce("lower", "low")).alias("low"),
                # a path that goes round a cycle would double without end; such paths are left out at last
                *(F.when(F.length("path") < 1 << 24, _below("above", "path")).otherwise(F.col("path")).alias("path") for _ in paths),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        if state.where("moved").isEmpty():
            return state.select(*columns[:4], F.lit(False).alias("cyclic"), *paths)
        state = state.drop("moved")
    ahead = state.select(F.col("node").alias("exit"), F.col("low").alias("cycle_low"))
    joined = lookup_join(state, ahead, "exit")
    cyclic = F.col("cycle_low").isNotNull()
    return joined.select("node", F.coalesce("cycle_low", "exit").alias("exit"), "steps", "low", cyclic.alias("cyclic"), *(F.when(~cyclic, F.col(c)).otherwise("").alias(c) for c in paths))


def _solve(links: DataFrame, solve_rows: int, part_rows: int, before: int | None = None) -> DataFrame:
    """Each node's root, steps and whether its way up ends in a cycle (then the root is its smallest node); with the path from below the root if links have paths."""
    links = cut(links)
    columns = _columns(links)
    paths = columns[4:]
    rows = links.count()
    stuck = before is not None and rows > 0.9 * before
    if rows <= part_rows or stuck and rows <= solve_rows:
        return _fragments(links, rows, max(rows, 1))
    if stuck:
        return _double(links, rows)
    local = cut(_fragments(links, rows, part_rows))
    open_ = local.where("NOT cyclic")
    exits = open_.select(F.col("exit").alias("node")).distinct()
    quotient = open_.join(exits, "node", "left_semi").select(*columns)
    solved = _solve(quotient, solve_rows, part_rows, rows)
    # exits whose own fragment closes on itself are solved already; others may end there
    loops = cut(local.where("cyclic").join(exits, "node", "left_semi").select(*columns, "cyclic"))
    ends = lookup_join(solved, loops.select(F.col("node").alias("exit"), F.col("exit").alias("loop")), "exit")
    solved = ends.select(
        "node", F.coalesce("loop", "exit").alias("exit"), "steps", "low", (F.col("cyclic") | F.col("loop").isNotNull()).alias("cyclic"), *paths
    )
    solved = cut(solved.unionByName(loops))
    top = solved.select(F.col("node").alias("exit"), F.col("exit").alias("root"), F.col("steps").alias("more"), F.col("cyclic").alias("loops"), *(F.col(c).alias("above") for c in paths))
    joined = lookup_join(open_, top, "exit")
    expanded = joined.select(
        "node",
        F.coalesce("root", "exit").alias("exit"),
        (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        "low",
        F.coalesce("loops", F.lit(False)).alias("cyclic"),
        *(_below("above", "path").alias("path") for _ in paths),
    )
    return expanded.unionByName(local.where("cyclic"))


def one_parent(links: DataFrame) -> DataFrame:
    """``(node, exit)``: each child of ``links(child, parent)`` with its parent, the smallest of several; links with a null on either side are none."""
    return links.where("child IS NOT NULL AND parent IS NOT NULL").groupBy(F.col("child").cast("long").alias("node")).agg(F.min(F.col("parent").cast("long")).alias("exit"))


def resolve_forest(links: DataFrame, solve_rows: int = SOLVE_ROWS, part_rows: int = PART_ROWS, paths: bool = False) -> DataFrame:
    """``(node, root, depth)`` for each id of ``links(child, parent)``, on either side.

    ``root`` is the topmost id above a node and ``depth`` the steps to it, 0 for a root. If the way up
    ends in a cycle, ``root`` is the cycle's smallest id and ``depth`` is -1. Repeated links count
    once; links with a null on either side are no links; of several parents of a child the smallest
    counts; a child that is its own parent is a cycle; no links give no rows. With ``paths`` also
    ``path``, the ids from the root down to the node joined by ``/``; null where depth is -1.
    """
    one = cut(one_parent(links))
    start = one.select("node", "exit", F.lit(1).cast("long").alias("steps"), F.col("node").alias("low"), *([F.col("node").cast("string").alias("path")] if paths else []))
    solved = cut(_solve(start, solve_rows, part_rows))
    tops = one.select(F.col("exit").alias("node")).distinct().join(one, "node", "left_anti")
    depth = F.when(F.col("cyclic"), F.lit(-1).cast("long")).otherwise(F.col("steps"))
    path = [F.when(~F.col("cyclic"), F.concat_ws("/", F.col("exit").cast("string"), "path")).alias("path")] if paths else []
    found = solved.select("node", F.col("exit").alias("root"), depth.alias("depth"), *path)
    own = [F.col("node").cast("string").alias("path")] if paths else []
    return found.unionByName(tops.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *own))


# --- numbers of descendants ----------------------------------------------------------------------

_SUMS = "node long, exit long, weight long, part long, top long, out long, total long"


def _add_up(rows: pa.Table) -> pa.Table:
    """Of the nodes at hand: the topmost one above each, where that one leads, and the weights of all below it and its own."""
    node, exit_, weight, part = (rows.column(c).to_numpy() for c in ("node", "exit", "weight", "part"))
    n = len(node)
    order = np.argsort(node, kind="stable")
    node, exit_, weight, part = node[order], exit_[order], weight[order], part[order]
    at = _at_hand(node, exit_)
    jump, last, hops = np.append(at, n), np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    while (go := jump[:n] < n).any():
        to = jump[:n]
        last[:n] = np.where(go, last[to], last[:n])
        hops[:n] = np.where(go, hops[:n] + hops[to], hops[:n])
        jump[:n] = jump[to]
    total, up = weight.tolist(), at.tolist()
    for k in np.argsort(-hops[:n], kind="stable").tolist():
        if up[k] < n:
            total[up[k]] += total[k]
    top = last[:n]
    return pa.table({"node": node, "exit": exit_, "weight": weight, "part": part, "top": node[top], "out": exit_[top], "total": pa.array(total, pa.int64())})


def _add_up_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        part = pa.array(np.full(rows.num_rows, TaskContext.get().partitionId()), pa.int64())
        yield from _add_up(rows.append_column("part", part)).to_batches(max_chunksize=100_000)


def _add_up_doubled(links: DataFrame) -> DataFrame:
    """The same over the cluster: after each round a node holds what lies less than twice as many steps below it."""
    state = links.select("node", "exit", F.col("weight").alias("total"))
    while True:
        sent = state.where("exit IS NOT NULL").groupBy(F.col("exit").alias("node")).agg(F.sum("total").alias("more"))
        ahead = state.select(F.col("node").alias("exit"), F.col("exit").alias("next"))
        joined = lookup_join(state.join(sent, "node", "left"), ahead, "exit")
        state = cut(joined.select("node", F.col("next").alias("exit"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
        if state.where("exit IS NOT NULL").isEmpty():
            return state.select("node", "total")


def _sums(links: DataFrame, solve_rows: int, part_rows: int, before: int | None = None) -> DataFrame:
    """``(node, total)``: the weights of each node of ``links(node, exit, weight)``, a forest, and of all below it.

    Fragments are added up within partitions. Their tops, each with its fragment's sum and linked to the
    top above its exit, form the quotient forest; its sums hang below the exits when the fragments are
    added up again.
    """
    links = cut(links.select("node", "exit", "weight"))
    rows = links.count()
    stuck = before is not None and rows > 0.9 * before
    if rows <= part_rows or stuck and rows <= solve_rows:
        return links.coalesce(1).mapInArrow(_add_up_batches, _SUMS).select("node", "total")
    if stuck:
        return _add_up_doubled(links)
    local = cut(links.repartitionByRange(math.ceil(rows / part_rows), "node").mapInArrow(_add_up_batches, _SUMS))
    tops = cut(local.where("node = top").select("node", F.col("out").alias("exit"), F.col("total").alias("weight")))
    home = local.select(F.col("node").alias("exit"), F.col("top").alias("up"))
    quotient = lookup_join(tops, home, "exit").select("node", F.coalesce("up", "exit").alias("exit"), "weight")
    solved = _sums(quotient, solve_rows, part_rows, rows)
    hang = tops.select("node", "exit").join(solved, "node").groupBy(F.col("exit").alias("node")).agg(F.sum("total").alias("more"))
    again = local.select("node", "exit", "weight", "part").join(hang, "node", "left").select("node", "exit", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"), "part")
    return again.groupBy("part").applyInArrow(_add_up, _SUMS).select("node", "total")


def _on_cycles(links: DataFrame) -> DataFrame:
    """``(node)`` of ``links(node, exit)`` whose ways up all end in cycles: those on one. After as many steps as there are links each way has come to one."""
    state = cut(links.select("node", F.col("exit").alias("at")))
    for _ in range(math.ceil(math.log2(state.count() + 1))):
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("next"))
        state = cut(lookup_join(state, ahead, "at", "inner").select("node", F.col("next").alias("at")))
    return state.select(F.col("at").alias("node")).distinct()


def descendant_counts(links: DataFrame, forest: DataFrame, cycles: bool = True, solve_rows: int = SOLVE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(node, n_descendants)`` of each id of ``forest``, which ``resolve_forest`` made of ``links``.

    Descendants on a cycle are all ids whose way up leads there. Without ``cycles`` ids of depth -1 count 0.
    """
    one = one_parent(links)
    tree = cut(forest.where("depth > 0").select("node", "root", "depth").join(one, "node"))
    total = cut(_sums(tree.select("node", "exit", F.lit(1).cast("long").alias("weight")), solve_rows, part_rows))
    roots = tree.where("depth = 1").select("node", "root").join(total, "node").groupBy(F.col("root").alias("node")).agg(F.sum("total").alias("n_descendants"))
    out = roots.unionByName(total.select("node", (F.col("total") - 1).alias("n_descendants")))
    looped = forest.where("depth < 0").select("node", "root")
    if not cycles:
        return out.unionByName(looped.select("node", F.lit(0).cast("long").alias("n_descendants")))
    ring = cut(looped.join(one, "node"))
    if ring.isEmpty():
        return out
    on = cut(_on_cycles(ring))
    hanging = ring.join(on, "node", "left_anti").select("node", "exit", F.lit(1).cast("long").alias("weight"))
    under = _sums(hanging, solve_rows, part_rows).select("node", (F.col("total") - 1).alias("n_descendants"))
    size = ring.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("n_descendants"))
    around = lookup_join(ring.join(on, "node", "left_semi").select("node", "root"), size, "root").select("node", "n_descendants")
    return out.unionByName(under).unionByName(around)


def full_hierarchy(links: DataFrame, cycles: bool = False, paths: bool = True, solve_rows: int = SOLVE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(node, root, depth, path, n_descendants)``: path from the root down, ids joined by ``/``.

    Nodes on or under a cycle have depth -1 and no path; with ``cycles`` they have descendants. Without
    ``paths``, whose total length is the square of a chain's, that column is left out.
    """
    links = cut(links.select("child", "parent"))
    forest = cut(resolve_forest(links, solve_rows, part_rows, paths))
    below = descendant_counts(links, forest, cycles, solve_rows, part_rows)
    return forest.join(below, "node", "left").select(*forest.columns, F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def ancestor_pairs(links: DataFrame, forest: DataFrame) -> DataFrame:
    """``(node, ancestor, distance)``: each acyclic node with itself (0) and all ids above it.

    Ancestors at distance up to 2d come from those up to d by one join, so a forest of depth D takes
    log2(D) joins. Read by ``ancestor`` this is the list of all descendants.
    """
    tree = forest.where("depth >= 0").select("node")
    one = one_parent(links).withColumnRenamed("exit", "ancestor")
    near = cut(one.join(tree, "node", "left_semi").withColumn("distance", F.lit(1).cast("long")))
    pairs, reach = near, 1
    deepest = forest.agg(F.max("depth")).first()[0] or 0
    while reach < deepest:
        far = pairs.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("middle"))
        step = pairs.select(F.col("node").alias("middle"), "ancestor", F.col("distance").alias("more"))
        more = far.join(step, "middle").select("node", "ancestor", (F.col("more") + reach).alias("distance"))
        pairs = cut(pairs.unionByName(more))
        reach *= 2
    return pairs.unionByName(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")))


def every_pair(links: DataFrame) -> DataFrame:
    """``(node, ancestor, distance)``: each id with every other id above it, on and below cycles as well.

    Links are taken as by ``resolve_forest``. On a cycle the other ids of it are ancestors, an id itself is none, and
    the first way round counts.
    """
    return all_pairs(one_parent(links).toDF("src", "dst")).select(F.col("seed").alias("node"), F.col("node").alias("ancestor"), F.col("depth").cast("long").alias("distance"))


# --- graphs with many parents per child ---------------------------------------------------------


def _components(edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes on cycles with the smallest node of their strongly connected component (iterative Tarjan)."""
    names, codes = np.unique(np.concatenate([edges["a"].to_numpy(object), edges["b"].to_numpy(object)]), return_inverse=True)
    n, m = len(names), len(edges)
    a, b = codes[:m], codes[m:]
    order = np.argsort(a, kind="stable")
    heads = b[order].tolist()
    start = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    own_loop = set(a[a == b].tolist())
    index, low, on, comp = [-1] * n, [0] * n, [False] * n, {}
    stack: list[int] = []
    count = 0
    for s in range(n):
        if index[s] >= 0:
            continue
        work = [(s, start[s])]
        index[s] = low[s] = count
        count += 1
        stack.append(s)
        on[s] = True
        while work:
            v, i = work.pop()
            if i < start[v + 1]:
                work.append((v, i + 1))
                w = heads[i]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, start[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if work:
                up = work[-1][0]
                low[up] = min(low[up], low[v])
            if low[v] == index[v]:
                group = []
                while True:
                    w = stack.pop()
                    on[w] = False
                    group.append(w)
                    if w == v:
                        break
                if len(group) > 1 or v in own_loop:
                    least = min(group)
                    comp.update(dict.fromkeys(group, least))
    keys = list(comp)
    return pd.DataFrame({"node": names[keys], "root": names[list(comp.values())]}, dtype=object)


def _components_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if held:
        yield _components(pd.concat(held))


def _spread(edges: DataFrame, label: DataFrame, src: str, dst: str) -> DataFrame:
    """Each node's smallest label among those that reach it over ``src -> dst`` within one ``colour``."""
    while True:
        sent = edges.join(label.select(F.col("node").alias(src), "mark"), src).select(F.col(dst).alias("node"), "mark")
        got = sent.groupBy("node").agg(F.min("mark").alias("new"))
        joined = label.join(got, "node", "left")
        better = F.coalesce(F.col("new") < F.col("mark"), F.lit(False))
        label = cut(joined.select("node", F.when(better, F.col("new")).otherwise(F.col("mark")).alias("mark"), better.alias("moved")))
        if label.where("moved").isEmpty():
            return label.drop("moved")
        label = label.drop("moved")


def _colour(edges: DataFrame) -> DataFrame:
    """Components over the cluster, of any size, by forward and backward colouring."""
    out = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        colour = cut(_spread(edges, nodes.withColumn("mark", F.col("node")), "a", "b"))
        # within a colour, the nodes that reach its smallest node are its component
        c1, c2 = (colour.select(F.col("node").alias(x), F.col("mark").alias(f"m{x}")) for x in "ab")
        inside = cut(edges.join(c1, "a").join(c2, "b").where("ma = mb").select("a", "b", F.col("ma").alias("colour")))
        marks = colour.select("node", F.when(F.col("node") == F.col("mark"), F.lit(0)).otherwise(F.lit(1)).alias("mark"))
        back = _spread(inside, marks, "b", "a")
        comp = cut(back.where("mark = 0").drop("mark").join(colour, "node").select("node", F.col("mark").alias("root")))
        loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
        large = comp.groupBy("root").count().where("count > 1").select("root")
        found = comp.join(large, "root", "left_semi").select("node", "root")
        found = cut(found.unionByName(comp.join(large, "root", "left_anti").join(loops, "node", "left_semi").select("node", "root")))
        out = found if out is None else out.unionByName(found)
        done = comp.select("node")
        edges = cut(
            inside.select("a", "b")
            .join(done.select(F.col("node").alias("a")), "a", "left_anti")
            .join(done.select(F.col("node").alias("b")), "b", "left_anti")
        )
    return out


def _trimmed(edges: DataFrame, rows: int, enough: int) -> tuple[DataFrame, int]:
    """Links without nodes that have no link in or none out, as long as many go and more than ``enough`` are left."""
    while rows > enough:
        into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = cut(edges.join(into, "a", "left_semi").join(out, "b", "left_semi"))
        before, rows = rows, edges.count()
        if rows > 0.9 * before:
            break
    return edges, rows


def _renamed(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between groups: each node replaced by the one it was contracted to."""
    for c in "ab":
        edges = lookup_join(edges, groups.select(F.col("node").alias(c), F.col("root").alias("_to")), c).withColumn(c, F.coalesce("_to", c)).select("a", "b")
    return edges.where("a <> b").distinct()


def cyclic_groups(edges: DataFrame, solve_rows: int = SOLVE_ROWS, part_rows: int = PART_ROWS, near: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)`` that reaches itself.

    ``root`` is the smallest node (by code points) among those that reach it and are reached by it.
    Repeated edges count once, edges with a null on either side are none, ``a = b`` is a cycle of one,
    and no edges give no rows. Nodes for which ``near`` gives the same are laid in the same partition,
    so cycles among them are contracted first.
    """
    edges = cut(edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    live = edges.where("a <> b")
    found, rows, parts = None, live.count(), None
    while rows:
        live, rows = _trimmed(live, rows, part_rows)
        parts = min(math.ceil(rows / part_rows), parts or rows)
        if rows > solve_rows * max(parts, 1):
            groups, last = _colour(live), True
        elif parts <= 1:
            groups, last = live.coalesce(1).mapInPandas(_components_task, "node string, root string"), True
        else:
            at = [F.pmod(F.xxhash64(near(F.col(c))), F.lit(parts)) for c in "ab"]
            inside = live.withColumn("part", at[0]).where(F.col("part") == at[1])
            groups, last = inside.repartition(parts, "part").select("a", "b").mapInPandas(_components_task, "node string, root string"), False
        if groups is None:
            break
        groups = cut(groups)
        if found is not None:
            moved = lookup_join(found.withColumnRenamed("root", "_at"), groups.select(F.col("node").alias("_at"), "root"), "_at")
            moved = moved.select("node", F.coalesce("root", "_at").alias("root"))
            groups_new = groups.join(found.select("node"), "node", "left_anti")
            found = cut(moved.unionByName(groups_new))
        else:
            found = groups
        if last:
            break
        live = cut(_renamed(live, groups))
        before, rows = rows, live.count()
        if rows > 0.9 * before:
            parts = max(1, parts // 4)
    return loops if found is None else found.unionByName(loops.join(found, "node", "left_anti"))


def clean_path(c: Column | str) -> Column:
    """A path with ``/`` for ``\\``, repeated ``/`` as one, and without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+", "/"), r"^\./", "")


def code_hierarchies(edge: DataFrame, include_dep: DataFrame) -> DataFrame:
    """Owner forests and include cycles: ``(hierarchy, node_key, root_key, depth)``."""
    links = edge.where("relation_type = 'belongs_to' AND to_id > 0").select(F.col("from_id").alias("child"), F.col("to_id").alias("parent"))
    owner = resolve_forest(links).select(
        F.lit("belongs_to").alias("hierarchy"), F.col("node").cast("string").alias("node_key"), F.col("root").cast("string").alias("root_key"), "depth"
    )
    include = include_dep.where("NOT is_system").select(clean_path(F.col("source_file")).alias("a"), clean_path(F.col("included_file")).alias("b"))
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    cycles = cyclic_groups(include, near=folder).select(
        F.lit("include").alias("hierarchy"), F.col("node").alias("node_key"), F.col("root").alias("root_key"), F.lit(-1).cast("long").alias("depth")
    )
    return owner.unionByName(cycles)


# --- including and included files ---------------------------------------------------------------

#: Seeds that walk together, as bits of eight words.
BLOCK = 512


def include_links(include_dep: DataFrame) -> DataFrame:
    """``(child, parent)``: each file with each file it includes, once, without system includes."""
    pair = include_dep.where("NOT is_system").select(clean_path(F.col("source_file")).alias("child"), clean_path(F.col("included_file")).alias("parent"))
    return pair.where("child IS NOT NULL AND parent IS NOT NULL").distinct()


def _numbered(links: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names in order of code points, and the places of children and parents among them."""
    names, codes = np.unique(np.concatenate([links["child"].to_numpy(object), links["parent"].to_numpy(object)]), return_inverse=True)
    return names, codes[: len(links)], codes[len(links) :]


def _below_task(parts: int, count: bool):
    """Files below each file of some of ``parts`` shares of the files, or their number, by levels of bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        every = pd.concat(held)
        for part, links in every.groupby("part"):
            names, child, parent = _numbered(links)
            order = np.argsort(child, kind="stable")
            ends, starts = np.unique(child[order], return_index=True)
            parent = parent[order]
            mine = np.arange(part, len(names), parts)
            for at in range(0, len(mine), BLOCK):
                seeds = mine[at : at + BLOCK]
                place = np.arange(len(seeds))
                front = np.zeros((len(names), BLOCK // 64), np.uint64)
                front[seeds, place // 64] = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
                seen, total, distance = front.copy(), np.zeros(len(seeds), np.int64), 0
                while True:
                    distance += 1
                    new = np.zeros_like(front)
                    new[ends] = np.bitwise_or.reduceat(front[parent], starts, axis=0) & ~seen[ends]
                    row, word = np.nonzero(new)
                    if not len(row):
                        break
                    seen |= new
                    front = new
                    bits = np.unpackbits(new[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    i, bit = np.nonzero(bits)
                    top = word[i] * 64 + bit
                    if count:
                        total += np.bincount(top, minlength=len(seeds))
                    else:
                        yield pd.DataFrame({"node": names[seeds[top]], "descendant": names[row[i]], "distance": np.full(len(i), distance, np.int64)})
                if count:
                    yield pd.DataFrame({"node": names[seeds], "n_descendants": total})

    return run


def _shares(links: DataFrame, parts: int) -> DataFrame:
    """All links for each of ``parts`` tasks."""
    return links.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "part")


def include_descendants(links: DataFrame, solve_rows: int = SOLVE_ROWS, parts: int = 12, count: bool = False) -> DataFrame:
    """``(node, descendant, distance)`` of ``links(child, parent)`` with many parents: every other file that leads up to a file, fewest steps.

    Up to ``solve_rows`` links, each of ``parts`` tasks holds all of them and walks down from its share
    of the files; above, pairs are doubled over the cluster. With ``count``: ``(node, n_descendants)``.
    """
    links = cut(links)
    if links.count() <= solve_rows:
        schema = "node string, n_descendants long" if count else "node string, descendant string, distance long"
        return _shares(links, parts).mapInPandas(_below_task(parts, count), schema)
    pairs = all_pairs(links.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    if count:
        return pairs.groupBy(F.col("seed").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return pairs.select(F.col("seed").alias("node"), F.col("node").alias("descendant"), F.col("depth").cast("long").alias("distance"))


def _shortest_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    links = pd.concat(held)
    names, child, parent = _numbered(links)
    below: list[list[int]] = [[] for _ in names]
    for c, p in zip(child.tolist(), parent.tolist(), strict=True):
        below[p].append(c)
    has = np.zeros(len(names), bool)
    has[child] = True
    # a level is walked in the order of its paths, so the first to reach a file has the smallest
    level = np.flatnonzero(~has).tolist()
    paths = {x: [names[x]] for x in level}
    while level:
        after = []
        for x in level:
            for y in sorted(below[x]):
                if y not in paths:
                    paths[y] = [*paths[x], names[y]]
                    after.append(y)
        level = after
    least = np.full(len(names), len(names))
    loops = np.searchsorted(names, _components(links.rename(columns={"child": "a", "parent": "b"}))["node"].to_numpy(object))
    least[loops] = loops
    while True:
        before = least.copy()
        np.minimum.at(least, child, before[parent])
        if (least == before).all():
            break
    for at in range(0, len(names), 10_000):
        some = range(at, min(at + 10_000, len(names)))
        yield pd.DataFrame({
            "node": names[at : at + 10_000],
            "root": [paths[x][0] if x in paths else names[least[x]] for x in some],
            "depth": [len(paths[x]) - 1 if x in paths else -1 for x in some],
            "path": [paths.get(x) for x in some],
        })


def _shortest(links: DataFrame) -> DataFrame:
    """The same over the cluster, one join a level."""
    up = links.select(F.col("child").alias("node")).distinct()
    front = links.select(F.col("parent").alias("node")).distinct().join(up, "node", "left_anti")
    front = cut(front.select("node", F.array("node").alias("path")))
    seen = front
    while not front.isEmpty():
        step = front.select(F.col("node").alias("parent"), "path").join(links, "parent").groupBy(F.col("child").alias("node")).agg(F.min("path").alias("path"))
        front = cut(step.join(seen, "node", "left_anti").select("node", F.concat("path", F.array("node")).alias("path")))
        seen = cut(seen.unionByName(front))
    rest = up.join(seen, "node", "left_anti")
    loops = cyclic_groups(links.select(F.col("child").alias("a"), F.col("parent").alias("b"))).select("node", F.col("node").alias("mark"))
    label = cut(rest.join(loops, "node", "left").select("node", F.coalesce("mark", F.lit("\U0010ffff")).alias("mark")))
    label = _spread(links, label, "parent", "child")
    found = seen.select("node", F.col("path")[0].alias("root"), (F.size("path") - 1).cast("long").alias("depth"), "path")
    return found.unionByName(label.select("node", F.col("mark").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path")))


def include_paths(links: DataFrame, solve_rows: int = SOLVE_ROWS, parts: int = 12) -> DataFrame:
    """``(node, root, depth, path, n_descendants)`` of each file of ``links(child, parent)``, which may have many parents.

    ``path`` leads from a file that includes none down to ``node``: the shortest one, and of several the
    smallest by its names in turn; ``root`` is its first file and ``depth`` its steps. A file above which are
    cycles only has no path, depth -1 and as root the smallest file on a cycle that it reaches.
    """
    links = cut(links)
    if links.count() <= solve_rows:
        found = links.coalesce(1).mapInPandas(_shortest_task, "node string, root string, depth long, path array<string>")
    else:
        found = _shortest(links)
    below = include_descendants(links, solve_rows, parts, count=True)
    return found.join(below, "node", "left").select("node", "root", "depth", "path", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))
