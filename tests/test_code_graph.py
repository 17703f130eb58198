import pytest
from pyspark.sql import functions as F

from lodegraph.operators import code, graph
from tests.conftest import rows

N = "id long, type string, name string, namespace string, file_path string, start_line int, end_line int, is_virtual boolean, is_pure_virtual boolean, is_abstract boolean, parent_class string, param_types array<string>"
E = "src long, dst long, relation_type string, line int, edge_id long, alias_name string"


def nodes_of(spark, *items):
    """(id, type, name, extra)."""
    base = {"namespace": None, "file_path": "f.cpp", "start_line": 1, "end_line": 9, "is_virtual": False, "is_pure_virtual": False, "is_abstract": False, "parent_class": None, "param_types": None}
    cols = [c.split()[0] for c in N.split(", ")]
    data = [{"id": i, "type": k, "name": n, **base, **(x[0] if x else {})} for i, k, n, *x in items]
    return spark.createDataFrame([tuple(d[c] for c in cols) for d in data], N)


def edges_of(spark, *items):
    return spark.createDataFrame([(a, b, r, (x[0] if x else 0), i, None) for i, (a, b, r, *x) in enumerate(items)], E)


def test_calls_and_expansion(spark):
    n = nodes_of(spark, (1, "class", "B"), (2, "class", "D"), (3, "function", "f", {"namespace": "B"}), (4, "function", "f", {"namespace": "D"}), (5, "function", "main"), (6, "function", "f", {"namespace": "E"}))
    e = edges_of(spark, (3, 1, "belongs_to"), (4, 2, "belongs_to"), (4, 3, "overrides"), (6, 4, "overrides"), (5, 3, "calls_virtual", 7), (5, 3, "calls_virtual", 8), (4, 5, "calls_direct", 9))
    assert rows(code.callers(e, n), "callee_id", "caller_name", "caller_class", "call_line") == [(3, "main", None, 7), (3, "main", None, 8), (5, "f", "D", 9)]
    assert rows(code.callees(e, n), "caller_id", "callee_name", "callee_class", "call_line") == [(4, "main", None, 9), (5, "f", "B", 7), (5, "f", "B", 8)]
    assert rows(code.override_closure(e)) == [(3, 4, 1), (3, 6, 2), (4, 6, 1)]
    assert rows(code.expanded_calls(e)) == [(4, 5, "calls_direct"), (5, 3, "calls_virtual"), (5, 4, "calls_virtual_expanded"), (5, 6, "calls_virtual_expanded")]
    seed = spark.createDataFrame([(3, 3)], "seed long, node long")
    assert rows(code.call_chain(seed, code.expanded_calls(e), "up", 1)) == [(3, 5, 1)]
    assert rows(code.call_chain(seed, code.expanded_calls(e), "up", 5)) == [(3, 4, 2), (3, 5, 1)]  # the cycle ends
    assert rows(code.uncalled(e, n), "id") == [(4,), (6,)]


def test_depth_limits_and_minimal_depth(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 1)], "src long, dst long")
    seed = spark.createDataFrame([(1, 1)], "seed long, node long")
    assert rows(graph.closure(seed, arcs, 1)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1)]
    assert rows(graph.closure(seed, arcs)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]
    every = arcs.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    assert rows(graph.all_pairs(arcs)) == rows(graph.closure(every, arcs, include_seeds=False))
    assert graph.all_pairs(arcs.limit(0)).count() == 0 == graph.closure(seed.limit(0), arcs).count()


def test_long_chain_by_doubling(spark):
    arcs = spark.createDataFrame([(i, i + 1) for i in range(37)], "src long, dst long")
    assert sorted(rows(graph.all_pairs(arcs))) == [(i, j, j - i) for i in range(37) for j in range(i + 1, 38)]


def test_inheritance_and_diamonds(spark):
    n = nodes_of(spark, (1, "class", "A", {"is_abstract": True}), (2, "class", "B"), (3, "class", "C"), (4, "struct", "D"), (5, "function", "v", {"is_virtual": True, "is_pure_virtual": True}), (6, "function", "v", {"is_virtual": True}))
    e = edges_of(spark, (2, 1, "inherits_public"), (3, 1, "inherits_private"), (4, 2, "inherits_public"), (4, 3, "inherits_public"), (5, 1, "belongs_to"), (6, 2, "belongs_to"), (6, 5, "overrides"))
    assert rows(code.inheritance(e)) == [(2, 1, 1), (3, 1, 1), (4, 1, 2), (4, 2, 1), (4, 3, 1)]
    assert rows(code.inheritance(e, "descendants", 1)) == [(1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1)]
    assert rows(code.diamonds(e)) == [(4, 1, 2, "2,3")]
    seed = spark.createDataFrame([(4, 4)], "seed long, node long")
    assert rows(code.inheritance_chain(e, seed)) == [(4, 1, 2, True), (4, 1, 2, True), (4, 2, 1, False), (4, 3, 1, False)]
    assert rows(code.implementations(e, n)) == [(1, 2, 1, False), (1, 3, 1, False), (1, 4, 2, False)]
    assert rows(code.virtual_functions(e, n), "class_id", "function_id", "from_class") == [(1, 5, 1), (2, 5, 1), (2, 6, 2), (3, 5, 1), (4, 5, 1), (4, 6, 2)]
    assert rows(code.virtual_table(e, n)) == [(1, 5, 1, "B::v"), (2, 6, 0, "")]


def test_diamonds_to_ten_levels(spark, tmp_path):
    import __spark_entry__

    # two ways of 5 and of 8 steps, one of 10 (kept) and one of 11 (beyond the ten levels), and a cycle
    links = []
    for start, steps in ((100, (5, 5)), (200, (8, 8)), (300, (2, 10)), (400, (2, 11))):
        for k, n in enumerate(steps):
            way = [start, *(start + 20 * (k + 1) + i for i in range(1, n)), start + 99]
            links += list(zip(way, way[1:], strict=False))
    links += [(500, 501), (501, 502), (502, 500), (500, 502)]
    spark.createDataFrame([(i, a, b, "inherits_public", None) for i, (a, b) in enumerate(links)], "id long, from_id long, to_id long, relation_type string, call_line int").write.parquet(f"{tmp_path}/edge.parquet")
    up = {}
    for a, b in links:
        up.setdefault(a, []).append(b)
    want = {}
    for s in up:
        front = [(s,)]
        for _ in range(10):
            front = [(*p, b) for p in front for b in up.get(p[-1], ()) if b not in p]
            for p in front:
                want.setdefault((s, p[-1]), []).append(p)
    want = sorted((s, t, len(ps), ",".join(map(str, sorted({x for p in ps for x in p[1:-1]})))) for (s, t), ps in want.items() if len(ps) > 1)
    assert {(200, 299), (300, 399)} < {w[:2] for w in want} and (400, 499) not in {w[:2] for w in want}
    assert rows(__spark_entry__.queries()["diamonds_full"](spark, str(tmp_path)), "derived", "base", "n_paths", "between") == want


def test_directions(spark):
    e = edges_of(spark, (2, 1, "inherits_public"), (5, 1, "belongs_to"), (5, 6, "calls_direct"))
    assert rows(graph.orient(e), "src", "dst") == [(1, 2), (1, 5), (5, 6)]
    assert rows(graph.orient(e, "incoming", ["calls_direct"]), "src", "dst") == [(6, 5)]
    assert graph.orient(e, "both").count() == 6
    with pytest.raises(ValueError, match="direction"):
        graph.orient(e, "sideways")


def test_traversals(spark):
    arcs = spark.createDataFrame([(1, 2, "r"), (1, 3, "r"), (2, 4, "r"), (3, 4, "r"), (4, 5, "r")], "src long, dst long, relation_type string")
    top, cut_off = graph.traverse(spark.createDataFrame([(1,)], "node long"), arcs, 2, 3)
    assert rows(top, "node", "depth", "parent") == [(1, 0, None), (2, 1, 1), (3, 1, 1)] and cut_off
    assert rows(graph.depth_first(1, arcs, 3)) == [(0, 1, 0), (1, 2, 1), (2, 4, 2), (3, 5, 3), (4, 3, 1)]
    assert rows(graph.depth_first(9, arcs, 3)) == [(0, 9, 0)]
    with pytest.raises(ValueError, match="more than"):
        graph.depth_first(1, arcs, 3, max_results=2)


def test_includes(spark):
    raw = spark.createDataFrame([("./b.cpp", "x//a.h", False), ("b.cpp", "x/a.h", None), ("x\\a.h", "b.h", False), ("c.cpp", "a.h", False), ("c.cpp", "vector", True), ("b.h", "a.h", False), (None, "a.h", False)], "source_file string, included_file string, is_system boolean")
    inc = code.clean_includes(raw)
    assert inc.count() == 5
    f = spark.createDataFrame([("y/b.h",), ("m.cpp",)], "file string")
    assert rows(code.includers(inc, f)) == [("y/b.h", "b.cpp", 2), ("y/b.h", "b.h", 2), ("y/b.h", "c.cpp", 2), ("y/b.h", "x/a.h", 1)]
    assert rows(code.include_impact(inc, f).where("is_source"), "file", "affected", "depth") == [("m.cpp", "m.cpp", 0), ("y/b.h", "b.cpp", 2), ("y/b.h", "c.cpp", 2)]
    assert rows(code.include_tree(inc, spark.createDataFrame([("b.cpp",)], "file string"))) == [("b.cpp", "b.cpp", "x/a.h", 1), ("b.cpp", "b.h", "a.h", 3), ("b.cpp", "x/a.h", "b.h", 2)]


def test_aliases(spark):
    e = edges_of(spark, *((i, i + 1, "type_alias") for i in range(1, 8)), (20, 21, "type_alias"), (21, 20, "type_alias"))
    got = {r.alias: (r.terminal, r.depth) for r in code.alias_terminals(e).collect()}
    assert got[1] == (6, 5) and got[5] == (8, 3) and got[20] == (21, 1)


def test_impact(spark):
    n = nodes_of(spark, (1, "class", "A"), (2, "function", "m", {"file_path": "a"}), (3, "class", "S"), (4, "function", "o", {"file_path": "s"}), (5, "function", "c", {"file_path": "x"}), (6, "function", "cc", {"file_path": "x"}), (7, "function", "far", {"file_path": "y"}))
    e = edges_of(spark, (2, 1, "belongs_to"), (3, 1, "inherits_public"), (4, 3, "belongs_to"), (4, 2, "overrides"), (5, 2, "calls_virtual"), (6, 5, "calls_direct"), (7, 6, "calls_direct"))
    seed = spark.createDataFrame([(1, 1)], "seed long, node long")
    got = code.blast_radius(e, n, seed, 2)
    assert rows(got, "name", "depth", "file_level") == [("S", 1, 1), ("c", 1, 1), ("cc", 2, 1), ("o", 1, 1)]
    assert rows(code.file_layers(got)) == [(1, "f.cpp", 1, 1), (1, "s", 1, 1), (1, "x", 1, 2)]
    assert code.blast_radius(e, n, seed.limit(0), 2).count() == 0


def test_resolution(spark):
    n = nodes_of(
        spark, (1, "class", "B"), (2, "class", "D"), (3, "function", "f", {"namespace": "ns::B", "param_types": ["int"]}), (4, "function", "f", {"namespace": "ns::B", "param_types": []}),
        (5, "function", "f", {"namespace": "q", "file_path": "a"}), (6, "function", "~B", {"namespace": "B"}), (7, "struct", "D"),
    )
    e = edges_of(spark, (2, 1, "inherits_public"), (3, 1, "belongs_to"), (6, 1, "belongs_to"))
    refs = [(1, "f", "B", ["int"]), (2, "f", "B", ["x"]), (3, "f", "Z", ["x"]), (4, "f", None, None), (5, "g", None, None), (6, None, None, None), (7, "f", "B", None), (8, "f", None, [])]
    calls = lambda items: spark.createDataFrame([(*x, None)[:5] for x in items], "edge_id long, name string, parent string, params array<string>, namespace string")
    assert rows(code.resolve_calls(calls(refs), n)) == [(1, 3, 1), (2, 3, 2), (3, 5, 3), (4, 5, 3), (7, 3, 2), (8, 4, 1)]
    over = spark.createDataFrame([(1, "f", "D", None, 9), (2, "~D", "D", "", 9), (3, "f", "B", None, 9), (4, None, "D", None, 9)], "edge_id long, name string, derived_class string, base_namespace string, src long")
    assert rows(code.resolve_overrides(over, e, n)) == [(1, 3), (2, 6)]
    # null parameters are unknown: the tail of the namespace decides, not an empty list elsewhere
    m = nodes_of(
        spark, (1, "function", "run", {"namespace": "x::Base", "param_types": ["int"]}), (2, "function", "run", {"namespace": "BaseImpl", "param_types": [], "file_path": "a"}),
        (3, "function", "go", {"namespace": "y", "file_path": "a"}), (4, "function", "go", {"namespace": "x::in::Other"}), (5, "function", "go", {"namespace": "x::inner"}),
    )
    assert rows(code.resolve_calls(calls([(1, "run", "Base", None), (2, "run", "Base", []), (3, "go", "Z", None, "x::in"), (4, "go", "Z", None, "x::i"), (5, "go", "", None, "x::in")]), m)) == [
        (1, 1, 2), (2, 2, 1), (3, 4, 2), (4, 3, 3), (5, 3, 3),
    ]
    # overrides: the namespace of the derived class, that of the function, and the virtual member that counts where none fits
    m = nodes_of(
        spark, (1, "class", "D", {"namespace": "a"}), (2, "class", "D", {"namespace": "b"}), (3, "class", "P", {}), (4, "class", "Q", {}), (5, "function", "f", {"namespace": "a::P"}),
        (6, "function", "f", {"namespace": "b::Q", "is_virtual": True}), (7, "function", "g", {"namespace": "c::P", "is_virtual": True}), (8, "function", "g", {"namespace": "c::P", "is_virtual": True}),
        (9, "function", "g", {"namespace": "c::P"}),
    )
    e = edges_of(spark, (1, 3, "inherits_public"), (2, 4, "inherits_public"), (6, 4, "belongs_to"), (7, 3, "belongs_to"), (8, 3, "belongs_to"))
    over = spark.createDataFrame(
        [(1, "f", "D", "a", 0), (2, "f", "D", "b", 0), (3, "f", "D", None, 0), (4, "g", "D", "a", 7), (5, "g", "D", "a", 0), (6, "g", "D", None, 7), (7, "f", "D", "z", 0)],
        "edge_id long, name string, derived_class string, base_namespace string, src long",
    )
    assert rows(code.resolve_overrides(over, e, m)) == [(1, 5), (2, 6), (3, 5), (4, 8), (5, 7), (6, 7)]
    using = spark.createDataFrame([(1, "g", "P"), (2, "f", "R"), (3, None, "P")], "edge_id long, name string, base_class string")
    assert rows(code.resolve_using(using, m)) == [(1, 7)]
    assert rows(code.resolve_types(spark.createDataFrame([(1, "D"), (2, "Q")], "edge_id long, name string"), n)) == [(1, 2)]
    fn = nodes_of(spark, (1, "function", "outer", {"start_line": 1, "end_line": 50}), (2, "function", "inner", {"start_line": 10, "end_line": 20}), (3, "function", "bad", {"start_line": 9, "end_line": 2}))
    sites = spark.createDataFrame([("f.cpp", 15), ("f.cpp", 30), ("f.cpp", 99), ("g.cpp", 15)], "file_path string, line int")
    assert rows(code.enclosing_function(fn, sites)) == [("f.cpp", 15, 2), ("f.cpp", 30, 1)]


def test_walks_with_arcs_at_hand_equal_distributed_ones(spark):
    import random

    from lodegraph.operators import graph

    r = random.Random(6)
    arcs = spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(None, 1), (2, None)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 99), (4, None), (None, 3)], "seed long, node long")
    for depth in (0, 2):
        assert rows(graph.closure(seeds, arcs, depth)) == rows(graph.closure(seeds.where("seed IS NOT NULL"), arcs, depth, held=0))
    assert rows(graph.all_pairs(arcs)) == rows(graph.all_pairs(arcs, held=0))
    named = arcs.selectExpr("concat('f', src) AS src", "concat('f', dst) AS dst")
    assert rows(graph.all_pairs(named)) == rows(graph.all_pairs(named, held=0))
    assert graph.closure(seeds.limit(0), arcs).count() == 0 == graph.all_pairs(arcs.limit(0)).count()
