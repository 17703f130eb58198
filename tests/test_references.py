from datetime import datetime as T

from pyspark.sql import functions as F

from lodegraph.operators import references
from lodegraph.runtime import hot_keys, lookup_join
from tests.conftest import rows


def test_plain_name(spark):
    names = ["A<B<C, D<int>>>::f<T>", "  Foo ", "::ns::Bar", "operator<<", "x<", None, "", "std::map<K, V>", "a<b<c<d<e<f<g<h<i<j>>>>>>>>>::z"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(references.plain_name("n").alias("p"))
    assert [r.p for r in df.collect()] == ["f", "Foo", "Bar", "operator<<", "x<", None, "", "map", "z"]


def ts(d):
    return T(2024, d, 1)


NODE = "id long, type string, name string, created_at timestamp, updated_at timestamp, deleted_at timestamp, key string"
EDGE = (
    "id long, to_id long, needs_resolution boolean, resolve_hint string, callee_name string, function_name string, target_simple_name string, "
    "relation_type string, created_at timestamp, kind string"
)


def test_orphan_edges(spark):
    node = spark.createDataFrame(
        [
            (1, "function", "f", ts(1), ts(1), None, ""), (1, "function", "f", ts(1), ts(1), None, ""),
            (2, "class", "C", ts(1), ts(2), ts(2), ""), (2, "class", "C", ts(1), ts(1), None, ""),
            (3, "struct", "L", ts(6), ts(6), None, ""),
            (4, "function", "g", ts(9), ts(9), None, ""), (5, "function", "ns::g<int>", ts(1), ts(9), ts(9), ""),
            (6, "function", None, None, None, None, ""), (7, "function", "u", None, ts(1), None, ""),
        ],
        NODE,
    )
    e = [
        (10, 1, False, None, None, None, None, "calls", ts(5), ""), (11, 2, None, None, None, None, None, "calls", ts(5), ""), (12, 3, False, None, None, None, None, "calls", ts(5), ""),
        (13, 99, True, None, None, None, None, "calls", ts(5), ""), (13, 99, True, None, None, None, None, "calls", ts(5), ""),
        (14, None, True, "type_alias", None, None, " x::C", "a", ts(5), ""), (15, 0, True, "type_alias", None, None, "f", "a", ts(5), ""),
        (16, -1, True, "override", "f", "ns::g", None, "o", ts(5), ""), (17, 0, True, None, "g<int>", None, None, "c", ts(10), ""), (18, 0, True, "using_decl", None, None, None, "u", None, ""),
        (19, 0, False, None, "nope", None, None, "c", ts(5), ""), (20, None, None, None, "nope", None, None, "c", ts(5), ""), (21, 0, True, "other", "nope", None, None, "c", ts(5), ""),
        (22, 0, True, None, "u", None, None, "c", ts(5), ""), (23, 3, False, None, None, None, None, "c", None, ""), (None, 99, False, None, None, None, None, "c", ts(1), ""),
    ]
    edge = spark.createDataFrame(e, EDGE)
    out = references.orphan_edges(edge, node)
    assert rows(out) == [
        (11, "deleted", "2024-05"), (12, "late", "2024-05"), (13, "missing", "2024-05"), (14, "deleted", "2024-05"), (15, "missing", "2024-05"),
        (16, "late", "2024-05"), (18, "missing", None),
    ]
    assert references.orphan_edges(edge.limit(0), node).count() == 0
    assert references.orphan_edges(edge, node.limit(0)).where("reason <> 'missing'").count() == 0
    assert references.orphan_report(out, edge).agg(F.sum("n_edges")).first()[0] == 7


def test_hot_key_is_salted(spark):
    refs = spark.range(30_000).select(F.col("id").alias("ref_id"), F.lit("k").alias("kind"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit(ts(1)).alias("at"))
    assert hot_keys(refs, "key", least=1000) == ["hot"]
    parents = spark.createDataFrame([("k", "hot", ts(2), None), ("k", "1", ts(1), None)], "kind string, key string, born timestamp, gone timestamp")
    references.hot_keys, plain = (lambda df, key: hot_keys(df, key, least=1000)), references.hot_keys
    try:
        got = {r[0]: r[1] for r in references.orphan_references(refs, parents).groupBy("reason").count().collect()}
    finally:
        references.hot_keys = plain
    assert got == {"late": 10_000, "missing": 19_999}


def test_lookup_join(spark):
    left = spark.range(100).select((F.col("id") % 4).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k long, v string")
    want = rows(left.join(right, "k", "left"), "k", "id", "v")
    assert rows(lookup_join(left, right, "k", hot=[0, 2]), "k", "id", "v") == want == rows(lookup_join(left, right, "k"), "k", "id", "v")
