"""Questions to a code graph: calls, inheritance, overrides, includes, aliases, impact.

``nodes`` and ``edges`` are the views of ``plans.views``; inheritance leads from child to parent, calls
from caller to callee, belongs_to from member to owner, overrides from derived to base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import all_pairs, closure, first_by, simple_paths
from lodegraph.operators.hierarchy import clean_path
from lodegraph.runtime import cut, keyed_join, measured

CALLS = ["calls_direct", "calls_virtual", "calls_callback"]


def of(edges: DataFrame, *relations: str) -> DataFrame:
    return edges.where(F.col("relation_type").isin(list(relations)))


def inherits(edges: DataFrame) -> DataFrame:
    """``(child, parent, access)`` once each."""
    e = edges.where(F.col("relation_type").startswith("inherits_"))
    return e.select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.regexp_replace("relation_type", "^inherits_", "").alias("access")).distinct()


def name_tail(c: str) -> Column:
    """The last part of a qualified name; null where there is only one part."""
    return F.when(F.col(c).contains("::"), F.element_at(F.split(c, "::"), -1))


# --- calls -----------------------------------------------------------------------------------------


def owners(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(member, owner_name)``: the first owning class of each member (J-10)."""
    e = of(edges, "belongs_to").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("owner_name")), "dst")
    return e.groupBy(F.col("src").alias("member")).agg(F.min(F.struct("edge_id", "owner_name")).alias("m")).select("member", "m.owner_name")


def call_sites(edges: DataFrame, nodes: DataFrame, call_types: list[str] | None = None) -> DataFrame:
    """All calls with both ends: ``(caller_id, callee_id, caller_name, callee_name, caller_file, call_line, call_type)``."""
    fn, fits = measured(nodes.where("type = 'function'").select("id", "name", "file_path"))
    calls = of(edges, *(call_types or CALLS))
    src = fn.select(F.col("id").alias("src"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
    dst = fn.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"))
    both = keyed_join(keyed_join(calls, src, "src", fits), dst, "dst", fits)
    return both.select(
        F.col("src").alias("caller_id"), F.col("dst").alias("callee_id"), "caller_name", "callee_name", "caller_file", F.col("line").alias("call_line"), F.col("relation_type").alias("call_type")
    )


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of every function its callers, once per (callee, caller name, file, line), with the caller's class (J-08, W-06)."""
    calls = call_sites(edges, nodes)
    one = first_by(calls, ["callee_id", "caller_name", "caller_file", "call_line"], F.col("caller_id"), F.col("call_type"))
    own = owners(edges, nodes).select(F.col("member").alias("caller_id"), F.col("owner_name").alias("caller_class"))
    return one.join(own, "caller_id", "left").select("callee_id", "callee_name", "caller_id", "caller_name", "caller_class", "caller_file", "call_line", "call_type")


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of every function its callees, once per (caller, callee name, line), with the callee's class or the tail of its namespace (J-09)."""
    calls = call_sites(edges, nodes)
    one = first_by(calls, ["caller_id", "callee_name", "call_line"], F.col("callee_id"), F.col("call_type"))
    own = owners(edges, nodes).select(F.col("member").alias("callee_id"), "owner_name")
    tail = nodes.select(F.col("id").alias("callee_id"), name_tail("namespace").alias("tail"))
    out = one.join(own, "callee_id", "left").join(tail, "callee_id")
    return out.select("caller_id", "callee_id", "callee_name", F.coalesce("owner_name", "tail").alias("callee_class"), "call_line", "call_type")


def override_closure(edges: DataFrame) -> DataFrame:
    """``(base, derived, depth)``: all direct (depth 1) and indirect overrides of every overridden function (G-07, G-08)."""
    arcs = of(edges, "overrides").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return all_pairs(arcs).select(F.col("seed").alias("base"), F.col("node").alias("derived"), "depth")


def expanded_calls(edges: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``(src, dst, via)``: calls, and of virtual calls also those of every override of the callee.

    ``overrides`` is their ``override_closure`` where it is at hand.
    """
    calls = of(edges, *CALLS).select("src", "dst", F.col("relation_type").alias("via"))
    over = (override_closure(edges) if overrides is None else overrides).select(F.col("base").alias("dst"), "derived")
    more = calls.where("via = 'calls_virtual'").join(over, "dst").select("src", F.col("derived").alias("dst"), F.lit("calls_virtual_expanded").alias("via"))
    return calls.unionByName(more).distinct()


def call_chain(seeds: DataFrame, calls: DataFrame, direction: str = "up", depth: int = 3) -> DataFrame:
    """``(seed, node, depth)``: callers (up) or callees (down) of seeds within ``depth`` calls, fewest first."""
    arcs = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if direction == "up" else calls.select("src", "dst")
    return closure(seeds, arcs, depth, include_seeds=False)


# --- inheritance ------------------------------------------------------------------------------------


def inheritance(edges: DataFrame, direction: str = "ancestors", depth: int = 0) -> DataFrame:
    """``(seed, node, depth)``: ancestors or descendants of every class; depth 0 is unlimited."""
    pairs = inherits(edges)
    up = pairs.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    arcs = up if direction == "ancestors" else up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if not depth:
        return all_pairs(arcs)
    arcs = cut(arcs.distinct())
    seeds = arcs.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    return closure(seeds, arcs, depth, include_seeds=False)


def inheritance_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = 20) -> DataFrame:
    """``(seed, node, depth, diamond)``: one row per path that arrives at an ancestor; diamond where several do."""
    arcs = inherits(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    paths = simple_paths(seeds, arcs, max_depth).where("depth > 0")
    from pyspark.sql import Window as W

    return paths.select("seed", "node", "depth", (F.count("*").over(W.partitionBy("seed", "node")) > 1).alias("diamond"))


def diamonds(edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """``(derived, base, n_paths, between)``: pairs joined by several simple paths, and the classes on them.

    Only classes with several parents can begin one, so paths are followed from those alone.
    """
    arcs = cut(inherits(edges).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct())
    seeds = arcs.groupBy("src").count().where("count > 1").select(F.col("src").alias("seed"), F.col("src").alias("node"))
    paths = simple_paths(seeds, arcs, max_depth).where("depth > 0")
    inner = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice("path", F.lit(2), F.greatest(F.col("depth") - 1, F.lit(0)))))))
    out = paths.groupBy(F.col("seed").alias("derived"), F.col("node").alias("base")).agg(F.count("*").alias("n_paths"), inner.alias("mid"))
    return out.where("n_paths > 1").select("derived", "base", "n_paths", F.array_join(F.transform("mid", lambda x: x.cast("string")), ",").alias("between"))


def virtual_functions(edges: DataFrame, nodes: DataFrame, inherited: bool = True) -> DataFrame:
    """``(class_id, function_id, name, from_class, pure)``: virtual functions of every class and its ancestors (G-09)."""
    classes = nodes.where("type IN ('class', 'struct')").select(F.col("id").alias("class_id"))
    own = classes.select("class_id", F.col("class_id").alias("owner"))
    if inherited:
        up = inheritance(edges).select(F.col("seed").alias("class_id"), F.col("node").alias("owner"))
        own = own.unionByName(up.join(classes, "class_id", "left_semi"))
    member = of(edges, "belongs_to").select(F.col("src").alias("function_id"), F.col("dst").alias("owner"))
    fn = nodes.where("type = 'function' AND is_virtual").select(F.col("id").alias("function_id"), "name", F.coalesce("is_pure_virtual", F.lit(False)).alias("pure"))
    out = own.join(member, "owner").join(fn, "function_id")
    return out.select("class_id", "function_id", "name", F.col("owner").alias("from_class"), "pure").distinct()


def abstract_classes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(class_id)`` of classes marked abstract or with a pure virtual member."""
    pure = nodes.where("type = 'function' AND is_pure_virtual").select(F.col("id").alias("src"))
    by_member = of(edges, "belongs_to").join(pure, "src", "left_semi").select(F.col("dst").alias("class_id"))
    marked = nodes.where("type IN ('class', 'struct') AND is_abstract").select(F.col("id").alias("class_id"))
    return by_member.union(marked).distinct()


def implementations(edges: DataFrame, nodes: DataFrame, include_abstract: bool = False) -> DataFrame:
    """``(interface, class_id, depth, is_abstract)``: classes below each abstract class."""
    abstract = cut(abstract_classes(edges, nodes))
    down = inherits(edges).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    below = closure(abstract.select(F.col("class_id").alias("seed"), F.col("class_id").alias("node")), down, include_seeds=False)
    flagged = below.join(abstract.select(F.col("class_id").alias("node"), F.lit(True).alias("abstract")), "node", "left")
    out = flagged.select(F.col("seed").alias("interface"), F.col("node").alias("class_id"), "depth", F.coalesce("abstract", F.lit(False)).alias("is_abstract"))
    return out if include_abstract else out.where("NOT is_abstract")


def virtual_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(class_id, function_id, n_overrides, overrides)``: each class's own virtual functions with their overrides as ``Class::f``."""
    own = virtual_functions(edges, nodes, inherited=False).select("class_id", "function_id")
    over = override_closure(edges).select(F.col("base").alias("function_id"), "derived")
    who = owners(edges, nodes).select(F.col("member").alias("derived"), "owner_name")
    fn = nodes.select(F.col("id").alias("derived"), "name")
    label = F.concat(F.coalesce("owner_name", F.lit("")), F.lit("::"), "name")
    named = over.join(fn, "derived").join(who, "derived", "left").select("function_id", "derived", label.alias("label"))
    listed = named.groupBy("function_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("overrides"))
    out = own.join(listed, "function_id", "left")
    return out.select("class_id", "function_id", F.coalesce("n", F.lit(0)).alias("n_overrides"), F.coalesce("overrides", F.lit("")).alias("overrides"))


def uncalled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions that nothing calls: ``(id, name)``."""
    called = of(edges, *CALLS).select(F.col("dst").alias("id"))
    return nodes.where("type = 'function'").select("id", "name").join(called, "id", "left_anti")


# --- includes ---------------------------------------------------------------------------------------


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def clean_includes(include_dep: DataFrame) -> DataFrame:
    """``(source_file, included_file, is_system)``, paths in one spelling, once per pair (system if any row says so)."""
    rows = include_dep.select(clean_path(F.col("source_file")).alias("source_file"), clean_path(F.col("included_file")).alias("included_file"), F.coalesce("is_system", F.lit(False)).alias("is_system"))
    return rows.where("source_file IS NOT NULL AND included_file IS NOT NULL").groupBy("source_file", "included_file").agg(F.max("is_system").alias("is_system"))


def includers(includes: DataFrame, files: DataFrame, max_depth: int = 20) -> DataFrame:
    """``(file, includer, depth)``: files that include each of ``files(file)``, directly or not, within ``max_depth``.

    A file is found by its base name, as includes are often written without their directory: the first
    hop and all later ones join on base names.
    """
    arcs = includes.select(basename("included_file").alias("src"), F.col("source_file").alias("to")).withColumn("dst", basename("to"))
    arcs = cut(arcs)
    seeds = files.select(F.col("file").alias("seed"), basename("file").alias("node"))
    reached = cut(closure(seeds, arcs, max_depth))
    inc = reached.join(arcs, F.col("node") == F.col("src")).where(F.col("depth") < max_depth)
    return inc.groupBy(F.col("seed").alias("file"), F.col("to").alias("includer")).agg((F.min("depth") + 1).alias("depth"))


def include_impact(includes: DataFrame, files: DataFrame, max_depth: int = 20) -> DataFrame:
    """Files to handle again when ``files(file)`` change: ``(file, affected, depth, is_source)``; a source file affects itself."""
    source = r"\.(cpp|cc|cxx|c)$"
    hit = includers(includes, files, max_depth).select("file", F.col("includer").alias("affected"), "depth")
    self_ = files.where(F.col("file").rlike(source)).select("file", F.col("file").alias("affected"), F.lit(0).alias("depth"))
    all_ = hit.unionByName(self_).groupBy("file", "affected").agg(F.min("depth").alias("depth"))
    return all_.withColumn("is_source", F.col("affected").rlike(source))


def include_tree(includes: DataFrame, files: DataFrame, max_depth: int = 5, skip_system: bool = True) -> DataFrame:
    """``(file, parent, child, depth)``: what files include, each child once, under its first parent."""
    arcs = includes.where("NOT is_system") if skip_system else includes
    arcs = cut(arcs.select(F.col("source_file").alias("src"), F.col("included_file").alias("dst")))
    reached = cut(closure(files.select(F.col("file").alias("seed"), F.col("file").alias("node")), arcs, max_depth))
    up = reached.select("seed", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    into = up.join(arcs, "src").select("seed", F.col("dst").alias("node"), "depth", "src")
    out = reached.where("depth > 0").join(into, ["seed", "node", "depth"]).groupBy("seed", "node", "depth").agg(F.min("src").alias("parent"))
    return out.select(F.col("seed").alias("file"), "parent", F.col("node").alias("child"), "depth")


def include_counts(includes: DataFrame) -> DataFrame:
    """``(source_file, n_includes, n_system)`` per file (A-10)."""
    return includes.groupBy("source_file").agg(F.count("*").alias("n_includes"), F.count_if("is_system").alias("n_system"))


# --- aliases ----------------------------------------------------------------------------------------


def aliases(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(target_id, target_name, alias_id, alias_name)`` for every aliased type (G-24)."""
    e = of(edges, "type_alias")
    target = nodes.select(F.col("id").alias("dst"), F.col("name").alias("target_name"))
    return e.join(target, "dst").select(F.col("dst").alias("target_id"), "target_name", F.col("src").alias("alias_id"), "alias_name").distinct()


def alias_terminals(edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """``(alias, terminal, depth)``: where a chain of aliases ends, within ``max_depth`` steps; cycles end where they began (G-25).

    Of several targets of one alias the smallest counts.
    """
    step = cut(of(edges, "type_alias").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next")))
    state = step.select(F.col("node").alias("alias"), F.col("next").alias("terminal"), F.lit(1).alias("depth"), F.array("node", "next").alias("path"))
    for _ in range(max_depth - 1):
        ahead = state.join(step, F.col("terminal") == F.col("node"), "left")
        go = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        state = ahead.select(
            "alias",
            F.when(go, F.col("next")).otherwise(F.col("terminal")).alias("terminal"),
            F.when(go, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(go, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
        )
    return state.drop("path")


def using_declarations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(class_id, function_id, function_name)``: functions that classes take over by using declarations (G-26)."""
    fn = nodes.select(F.col("id").alias("dst"), F.col("name").alias("function_name"))
    return of(edges, "using_decl").join(fn, "dst").select(F.col("src").alias("class_id"), F.col("dst").alias("function_id"), "function_name").distinct()


# --- impact -----------------------------------------------------------------------------------------


def impact_seeds(edges: DataFrame, seeds: DataFrame, overrides: DataFrame | None, subclasses: bool = True) -> DataFrame:
    """``(seed, node, depth)``: changed nodes, their members and subclasses with members, and overrides of all these if given."""
    base = seeds.select("seed", "node", F.lit(0).alias("depth"))
    member = of(edges, "belongs_to").select(F.col("dst").alias("node"), F.col("src").alias("member"))
    out = base.unionByName(base.join(member, "node").select("seed", F.col("member").alias("node"), F.lit(0).alias("depth")))
    if subclasses:
        child = inherits(edges).select(F.col("parent").alias("node"), "child")
        sub = base.join(child, "node").select("seed", F.col("child").alias("node"), F.lit(1).alias("depth"))
        out = out.unionByName(sub).unionByName(sub.join(member, "node").select("seed", F.col("member").alias("node"), F.lit(1).alias("depth")))
    out = out.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    if overrides is not None:
        out = cut(out)
        over = overrides.select(F.col("base").alias("node"), "derived")
        out = out.unionByName(out.join(over, "node").select("seed", F.col("derived").alias("node"), F.lit(1).alias("depth")))
    return out.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def blast_radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "up", overrides: bool = True, subclasses: bool = True) -> DataFrame:
    """``(seed, node, name, file_path, depth, file_level)``: what a change of ``seeds(seed, node)`` affects within ``depth``.

    ``depth`` is clamped to 1..5. Starts from ``impact_seeds``, follows calls (virtual ones expanded)
    up to callers or down to callees, keeps the smallest depth of a node and gives each file the
    smallest depth of its nodes. The changed nodes themselves are left out.
    """
    depth = min(max(depth, 1), 5)
    over = cut(override_closure(edges))
    start = cut(impact_seeds(edges, seeds, over if overrides else None, subclasses))
    chain = call_chain(start.select("seed", "node"), expanded_calls(edges, over), direction, depth).select("seed", "node", "depth")
    found = start.where("depth > 0").unionByName(chain).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    found = found.join(seeds.select("seed", "node"), ["seed", "node"], "left_anti")
    out = found.join(nodes.select(F.col("id").alias("node"), "name", "file_path"), "node")
    from pyspark.sql import Window as W

    return out.select("seed", "node", "name", "file_path", "depth", F.min("depth").over(W.partitionBy("seed", "file_path")).alias("file_level"))


def file_layers(impact: DataFrame) -> DataFrame:
    """``(seed, file_path, level, n_nodes)`` of a blast radius (A-06)."""
    return impact.groupBy("seed", "file_path").agg(F.min("depth").alias("level"), F.count("*").alias("n_nodes"))


# --- call and override resolution -------------------------------------------------------------------


def _by_signature(refs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``refs`` with a column ``sig`` for their ``columns``, and the distinct signatures; each is resolved once, however many edges have it."""
    signed = cut(refs.where("name IS NOT NULL").withColumn("sig", F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})))
    return signed, signed.select("sig", *columns).dropDuplicates(["sig"])


def _first(candidates: DataFrame, *keys: str) -> DataFrame:
    """The first candidate of each key by file, line and id, as ``best``."""
    return candidates.groupBy(*keys).agg(F.min("place").alias("best"))


def resolve_calls(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, target, tier)``: the best function for each call known by name only (J-07, W-01).

    ``refs(edge_id, name, parent, params, namespace)``; tier 1, for calls whose parameters are known:
    same name and parameters, and the parent is the tail of the namespace or part of it (or none is
    given); tier 2, for calls with a parent: same name, and the parent is the tail of the namespace or
    the call's namespace leads to it; tier 3: same name. Within a tier the first by (file, line, id)
    counts. Null parameters are unknown, not none; names without a function give no row.

    Functions are reduced to one row per name and what a tier compares, and calls to their signatures,
    before they meet, so overloads of a common name don't multiply with its calls. The last join, of edges
    to their one signature each, is left to adaptive execution, which splits skewed partitions.
    """
    signed, sigs = _by_signature(refs, ["name", "parent", "params", "namespace"])
    sigs = sigs.withColumn("parent", F.nullif("parent", F.lit(""))).withColumn("namespace", F.nullif("namespace", F.lit("")))
    place = F.struct(F.coalesce("file_path", F.lit("")).alias("f"), F.coalesce("start_line", F.lit(0)).alias("l"), "id").alias("place")
    space = F.coalesce("namespace", F.lit(""))
    fn = cut(nodes.where("type = 'function' AND name IS NOT NULL").select("name", space.alias("space"), F.to_json(F.struct("param_types"), {"ignoreNullFields": "true"}).alias("list"), F.col("param_types").isNotNull().alias("listed"), place))
    want = sigs.where("params IS NOT NULL").select("sig", "name", "parent", F.to_json(F.struct(F.col("params").alias("param_types")), {"ignoreNullFields": "true"}).alias("list"))
    same = fn.where("listed")
    alone = want.where("parent IS NULL").join(_first(same, "name", "list"), ["name", "list"]).select("sig", "best")
    owned = want.where("parent IS NOT NULL").join(_first(same, "name", "list", "space"), ["name", "list"]).where(F.col("space").contains(F.col("parent"))).select("sig", "best")
    one = alone.unionByName(owned).withColumn("tier", F.lit(1))
    tail = F.element_at(F.split("space", "::"), -1)
    by_tail = sigs.where("parent IS NOT NULL").join(_first(fn.withColumn("parent", tail), "name", "parent"), ["name", "parent"]).select("sig", "best")
    parts = F.split("space", "::")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))
    led = fn.where(F.size(parts) > 1).withColumn("namespace", F.explode(heads))
    by_head = sigs.where("parent IS NOT NULL AND namespace IS NOT NULL").join(_first(led, "name", "namespace"), ["name", "namespace"]).select("sig", "best")
    two = by_tail.unionByName(by_head).withColumn("tier", F.lit(2))
    three = sigs.join(_first(fn, "name"), "name").select("sig", "best", F.lit(3).alias("tier"))
    best = one.unionByName(two).unionByName(three).groupBy("sig").agg(F.min(F.struct("tier", "best")).alias("m"))
    found = best.select("sig", F.col("m.best.id").alias("target"), "m.tier")
    return signed.select("edge_id", "sig").join(found, "sig").select("edge_id", "target", "tier")


def resolve_overrides(refs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, target)``: the function that a derived class overrides, in one of its direct bases (J-04, F-20).

    ``refs(edge_id, name, derived_class, base_namespace, src)``. The derived class is found by name, and
    by a namespace that is, begins or ends with ``base_namespace`` where one is given; its bases by
    inheritance; their function by name (a destructor's is that of its base) and a namespace whose tail
    is the base and that ``base_namespace`` leads to. Where no base has one, a virtual member whose
    namespace's tail is a base counts, other than ``src`` itself. The derived class with the smallest id
    counts first, then the base with the smallest, then the function with the smallest.
    """
    signed, sigs = _by_signature(refs, ["name", "derived_class", "base_namespace", "src"])
    ns = F.nullif("base_namespace", F.lit(""))
    cls = nodes.where("type IN ('class', 'struct')").select("id", "name", F.coalesce("namespace", F.lit("")).alias("space"))
    child = cls.select(F.col("id").alias("child"), F.col("name").alias("derived_class"), "space")
    parent = cls.select(F.col("id").alias("parent"), F.col("name").alias("base_name"))
    here = ns.isNull() | (F.col("space") == ns) | F.col("space").startswith(F.concat(ns, F.lit("::"))) | F.col("space").endswith(F.concat(F.lit("::"), ns))
    bases = sigs.join(child, "derived_class").where(here).drop("space").join(inherits(edges).select("child", "parent").distinct(), "child").join(parent, "parent")
    want = F.when(F.col("name").startswith("~"), F.concat(F.lit("~"), "base_name")).otherwise(F.col("name"))
    bases = cut(bases.select("sig", "src", "child", "parent", "base_name", ns.alias("ns"), want.alias("want")))
    tail = F.element_at(F.split("space", "::"), -1)
    fn = nodes.where("type = 'function'").select("id", F.col("name").alias("want"), F.coalesce("namespace", F.lit("")).alias("space"), F.coalesce("is_virtual", F.lit(False)).alias("is_virtual")).withColumn("base_name", tail)
    named = fn.groupBy("want", "base_name", "space").agg(F.min("id").alias("id"))
    main = bases.join(named, ["want", "base_name"]).where(F.col("ns").isNull() | F.col("space").startswith(F.concat("ns", F.lit("::"))))
    member = of(edges, "belongs_to").select(F.col("src").alias("id")).distinct()
    # the first two, as one of them may be the function itself
    virtual = first_by(fn.where("is_virtual").join(member, "id", "left_semi"), ["want", "base_name"], F.col("id"), most=2).select("want", "base_name", "id")
    back = bases.join(virtual, ["want", "base_name"]).where(~F.col("id").eqNullSafe(F.col("src")))
    every = main.select("sig", F.lit(1).alias("tier"), "child", "parent", "id").unionByName(back.select("sig", F.lit(2).alias("tier"), "child", "parent", "id"))
    best = every.groupBy("sig").agg(F.min(F.struct("tier", "child", "parent", "id")).alias("m")).select("sig", F.col("m.id").alias("target"))
    return signed.select("edge_id", "sig").join(best, "sig").select("edge_id", "target")


def resolve_types(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, target)``: the first class, else struct, of a simple name (``refs(edge_id, name)``)."""
    rank = F.when(F.col("type") == "class", 0).otherwise(1)
    cls = nodes.where("type IN ('class', 'struct')").groupBy("name").agg(F.min(F.struct(rank.alias("r"), "id")).alias("m"))
    return refs.join(cls.select("name", F.col("m.id").alias("target")), "name").select("edge_id", "target")


def resolve_using(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, target)``: the first function of ``refs(edge_id, name, base_class)`` whose namespace's tail is the class (J-06)."""
    tail = F.element_at(F.split(F.coalesce("namespace", F.lit("")), "::"), -1)
    fn = nodes.where("type = 'function'").select("name", tail.alias("base_class"), "id").groupBy("name", "base_class").agg(F.min("id").alias("target"))
    return refs.join(fn, ["name", "base_class"]).select("edge_id", "target")


def enclosing_function(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """``(file_path, line, function_id)``: the smallest function around each ``sites(file_path, line)``.

    The join is by file; within it, by the line's interval.
    """
    fn = nodes.where("type = 'function' AND start_line <= end_line").select("id", "file_path", "start_line", "end_line")
    hit = sites.join(fn, "file_path").where("line BETWEEN start_line AND end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "id")).alias("m")
    return hit.groupBy("file_path", "line").agg(best).select("file_path", "line", F.col("m.id").alias("function_id"))
