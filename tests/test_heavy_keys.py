from collections import Counter

from pyspark.sql import functions as F

from lodegraph.operators import heavy_keys
from tests.conftest import rows

EDGE = "from_id long, to_id long, relation_type string, call_line int, label string, target string, n string"


def test_counts(spark):
    data = [(1, 5, "a", None), (1, 5, "a", 0), (1, 5, "a", 2), (2, 5, "b", 1), (2, 0, "a", 1), (2, None, "a", 1), (2, -1, "a", 1), (None, 5, None, 1), (3, 2**40, "a", 1)]
    df = spark.createDataFrame([(*x, "l", "t", "n") for x in data], EDGE)
    assert rows(heavy_keys.target_counts(df)) == sorted([("a", 5, 2), ("b", 5, 1), (None, 5, 1), ("a", 2**40, 1)], key=repr)
    assert rows(heavy_keys.heavy_targets(df, 0.4), "relation_type", "to_id") == [("a", 5)]
    assert heavy_keys.target_counts(df.limit(0)).count() == 0 == heavy_keys.heavy_targets(df.limit(0)).count()


def test_one_key_holds_most_rows(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 11)).alias("l"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("t"))
    want = Counter((r.l, r.t) for r in df.collect())
    heavy_keys.BLOCK_ROWS, block = 1000, heavy_keys.BLOCK_ROWS
    try:
        got = {(a, b): n for a, b, n in rows(heavy_keys.key_counts(df, "l", "t", splits=5))}
    finally:
        heavy_keys.BLOCK_ROWS = block
    assert got == want
