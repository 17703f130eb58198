"""Building and refreshing a code graph from parse results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import code, store
from lodegraph.runtime import cut
from lodegraph.sources import parse_results


def resolved_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes: those given by key, and those known by name, resolved by their hint (J-03..J-07, U-05).

    Keys come first, so that overrides can follow the inheritance they gave. Edges that find no target
    are left out; one edge per (src, dst, relation, line).
    """
    keyed = store.edge_keys(raw.withColumn("edge_id", F.xxhash64("from_key", "to_key", "relation_type", "call_line", "callee_name", "function_name", "target_simple_name")), nodes)
    keyed = cut(keyed.withColumn("line", F.coalesce("call_line", F.lit(0))))
    done = keyed.where("dst IS NOT NULL")
    todo = keyed.where("dst IS NULL AND needs_resolution")
    base = done.select("src", "dst", "relation_type", "line", "edge_id")
    by_hint = lambda h: todo.where(F.col("resolve_hint").eqNullSafe(F.lit(h)))
    calls = code.resolve_calls(by_hint(None).select("edge_id", F.col("callee_name").alias("name"), F.col("callee_parent_class").alias("parent"), F.col("callee_param_types").alias("params"), F.col("callee_namespace").alias("namespace")), nodes)
    overrides = code.resolve_overrides(by_hint("override").select("edge_id", F.col("function_name").alias("name"), "derived_class", "base_namespace", "src"), base, nodes)
    aliases = code.resolve_types(by_hint("type_alias").select("edge_id", F.col("target_simple_name").alias("name")), nodes)
    using = code.resolve_using(by_hint("using_decl").select("edge_id", F.col("function_name").alias("name"), "base_class"), nodes)
    found = calls.select("edge_id", "target").unionByName(overrides).unionByName(aliases).unionByName(using)
    late = todo.drop("dst").join(found, "edge_id").withColumn("dst", F.col("target")).drop("target")
    return done.unionByName(late).dropDuplicates(["src", "dst", "relation_type", "line"])


def build(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, includes and statuses of parse results (S-31)."""
    nodes = cut(parse_results.nodes(results))
    return nodes, resolved_edges(parse_results.edges(results), nodes), parse_results.includes(results), parse_results.statuses(results)


def affected(includes: DataFrame, changes: DataFrame) -> DataFrame:
    """``(file)`` to parse again after ``changes(status, file)``: sources themselves, and all sources that include a changed header (G-28)."""
    hit = code.include_impact(includes, changes.select("file").distinct())
    return hit.where("is_source").select(F.col("affected").alias("file")).distinct()


def refresh(nodes: DataFrame, edges: DataFrame, results: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after ``results`` are taken over (U-06..U-12).

    Out-edges of the parsed files are replaced, nodes that a successful parse no longer has vanish with
    their edges, deleted files vanish wholly, and a failed parse changes nothing of its file. Taking
    over the same results again changes nothing (C-05).
    """
    status = parse_results.statuses(results)
    good = results.where("status <> 'failed'")
    new_nodes, new_edges = cut(parse_results.nodes(good)), parse_results.edges(good)
    gone = store.vanished(nodes, new_nodes, status)
    deleted = nodes.join(changes.where("status = 'D'").select(F.col("file").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    kept, left = store.drop_nodes(nodes, edges, gone.union(deleted))
    parsed = status.where("status <> 'failed'").select(F.col("source_file").alias("file_path"))
    left = store.drop_out_edges(left, kept, parsed)
    merged = cut(store.upsert(kept, new_nodes.select(kept.columns), ["unique_key"]))
    added = resolved_edges(new_edges, merged).select(left.columns)
    out = store.upsert(left, added, ["src", "dst", "relation_type", "line"])
    return merged, cut(store.with_both_ends(out, merged))
