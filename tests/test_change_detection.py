from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import incremental, merkle, snapshots
from tests.conftest import rows

PS = "id long, source_file string, status string, error_message string, node_count int, edge_count int, file_hash string, parsed_at timestamp, loaded_at timestamp, extra string"
PF = "run_id string, source_file string, file_hash string, processed_at timestamp"
UR = "run_id string, started_at timestamp, finished_at timestamp, state string"


def t(day):
    return T(2024, 1, day)


def status(spark, *items):
    return spark.createDataFrame([(i, f, s, None, None, None, h, at, None, "x") for i, f, s, h, at in items], PS)


def found(spark, ps, pf, ur):
    return [r[0] for r in rows(incremental.files_to_update(ps, spark.createDataFrame(pf, PF), spark.createDataFrame(ur, UR)), "source_file")]


def test_files_to_update(spark):
    ps = status(
        spark,
        (1, "a", "success", "H1", t(1)), (1, "a", "success", "H1", t(1)), (2, "a", " Partial ", " md5:h2", t(2)), (3, "a", "failed", "h9", t(3)),
        (4, "b", "success", "x", t(1)),
        (5, "c", "SUCCESS", "  ", t(5)), (6, "c", "success", None, t(6)),
        (7, "d", "success", "tie1", t(4)), (8, "d", "success", "tie2", t(4)),
        (9, None, "success", "q", t(1)), (10, "e", None, "q", t(1)), (11, "f", "success", "old", None), (12, "f", "success", "new", t(1)),
    )
    ur = [("r1", t(1), t(2), "success"), ("r2", t(3), t(4), "failed"), ("r3", t(5), None, "running"), ("r4", t(5), t(6), "Success ")]
    pf = [("r1", "a", "h1", t(1)), ("r4", "a", "MD5:H2 ", t(6)), ("r2", "b", "x", t(4)), ("r4", "d", "tie1", t(6)), ("r4", "f", "new", None), (None, "f", "z", None), ("r4", None, "z", None)]
    assert found(spark, ps, pf, ur) == ["b", "d"]


def test_files_to_update_empty(spark):
    none = status(spark)
    assert found(spark, none, [], []) == []
    one = status(spark, (1, "a", "success", "h", t(1)))
    assert found(spark, one, [], []) == ["a"]
    assert found(spark, none, [("r", "a", "h", t(1))], [("r", t(1), t(1), "success")]) == []


def test_merkle_descent_finds_exactly_the_differing_leaves(spark):
    a = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    b = a.where("key <> '17'").withColumn("value", F.when(F.col("key") == "99", None).otherwise(F.col("value")))
    depth = 2
    trees = [merkle.tree(merkle.leaves(incremental.with_digests(x, depth)), depth) for x in (a, b)]
    differ = {r[0] for r in merkle.differing_leaves(*trees, depth).collect()}
    want = {r[0] for r in a.where("key IN ('17', '99')").select(merkle.leaf_of(F.col("key"), depth)).collect()}
    assert differ == want
    assert merkle.differing_leaves(trees[0], trees[0], depth).count() == 0
    assert rows(incremental.changed_records(a, b, depth), "key") == [("17",), ("99",)]


def test_store_publishes_output_and_tree_together(spark, tmp_path):
    store = incremental.IncrementalStore(spark, str(tmp_path), leaf_rows=2)
    now = spark.createDataFrame([(f"k{i}", "1") for i in range(50)] + [("none", None)], "key string, value string")
    done = []

    def process(df):
        done.append(df.count())
        return df

    store.run(now, process)
    assert done == [51] and store.outputs().count() == 51

    changed = now.where("key <> 'k3'").withColumn("value", F.when(F.col("key").isin("k7", "none"), "2").otherwise(F.col("value")))
    with pytest.raises(RuntimeError, match="dies"):
        store.run(changed, lambda df: (_ for _ in ()).throw(RuntimeError("dies")))
    publish = store.published.publish
    store.published.publish = lambda *a: (_ for _ in ()).throw(RuntimeError("dies late"))
    with pytest.raises(RuntimeError, match="dies late"):
        store.run(changed, process)
    store.published.publish = publish
    assert store.outputs().count() == 51 and len(store.runs()) == 1

    again = incremental.IncrementalStore(spark, str(tmp_path), leaf_rows=2)
    again.run(changed, process)
    assert done[-1] == 2 and rows(again.outputs().where("value = '2'"), "key") == [("k7",), ("none",)]
    again.run(changed, process)
    assert done[-1] == 0
    again.compact()
    again.run(now, process)
    assert done[-1] == 3  # the record that had gone is new
    assert rows(again.saved_state(), "key", "value") == rows(now, "key", "value")


def test_only_differing_leaves_are_read(spark, tmp_path):
    store = incremental.IncrementalStore(spark, str(tmp_path), leaf_rows=8, part_rows=100)
    now = spark.range(4000).selectExpr("CAST(id AS STRING) AS key", "'1' AS value")
    store.run(now, lambda df: df)
    run = store.run(now.withColumn("value", F.when(F.col("key") == "77", "2").otherwise(F.col("value"))), lambda df: df)
    entry = store.entry(run)
    assert (entry["n_leaves"], entry["n_differing"], entry["whole"]) == (1000, 1, False) and rows(store.output(run)) == [("77", "2")]
    # what the run wrote anew is one leaf's rows; what it read of the saved state is one of its folders
    leaves = spark.read.parquet(f"{tmp_path}/state/{run}")
    assert leaves.select("part").distinct().count() == 1 and leaves.count() < 30
    plan = store.saved_state(leaves.select("leaf").distinct())._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters", 1)[1][:80]
    # eight times the records: another shape, the same result
    more = spark.range(60_000).selectExpr("CAST(id AS STRING) AS key", "IF(id = 77, '2', '1') AS value")
    run = store.run(more, lambda df: df)
    assert store.output(run).count() == 56_000 and store.entry(run)["whole"] and store.entry(run)["n_leaves"] > 4000
    run = store.run(more, lambda df: df)
    assert store.output(run).count() == 0 and store.saved_state().count() == 60_000


def test_of_two_runs_at_once_one_is_published(spark, tmp_path):
    from lodegraph.publish import TakenError

    a, b = (incremental.IncrementalStore(spark, str(tmp_path)) for _ in range(2))
    one, two = (spark.createDataFrame([(x, "1")], "key string, value string") for x in ("a", "b"))
    with pytest.raises(TakenError):
        a.run(one, lambda df: b.run(two, lambda x: x) and df)
    assert rows(a.outputs()) == [("b", "1")] and len(a.runs()) == 1
    a.run(one, lambda df: df)
    assert rows(a.saved_state(), "key") == [("a",)]


def changes(df):
    return rows(snapshots.snapshot_changes(snapshots.deliveries(df, "e", "no", F.col("k"), [F.col("v"), F.col("w")], "at"), leaf_rows=2), "snapshot_no", "record_key", "change_kind")


def test_snapshot_changes(spark):
    s = "no int, k string, v string, w int, at timestamp, entity string, leaf string"
    df = spark.createDataFrame(
        [
            (1, "a", "x", 1, t(1), "", ""), (1, "b", "x", 1, t(1), "", ""), (1, "c", None, 1, t(1), "", ""), (1, "d", "x", 2, None, "", ""), (1, "d", "x", 1, t(1), "", ""),
            (3, "a", "x", 1, t(1), "", ""), (3, "a", "x", 1, t(1), "", ""), (3, "b", "y", 1, t(2), "", ""), (3, "b", "z", 1, t(1), "", ""), (3, "c", None, None, t(1), "", ""), (3, "d", "x", 1, None, "", ""),
            (7, "a", "x", 1, t(1), "", ""), (7, "e", None, None, t(1), "", ""), (7, None, "q", 1, t(1), "", ""), (None, "z", "q", 1, t(1), "", ""),
        ],
        s,
    )
    assert changes(df) == [(3, "b", "changed"), (3, "c", "changed"), (7, "b", "removed"), (7, "c", "removed"), (7, "d", "removed"), (7, "e", "added")]
    assert changes(df.where("no = 1")) == [] and changes(df.limit(0)) == []


def test_snapshot_changes_with_one_key_holding_most_rows(spark):
    many = spark.range(20_000).select(F.lit(1).alias("no"), F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"), F.lit(1).alias("w"), F.timestamp_seconds("id").alias("at"))
    two = spark.createDataFrame([(2, "hot", "19999", 1, t(1)), (2, "new", "", 1, t(1))], "no int, k string, v string, w int, at timestamp")
    assert changes(many.unionByName(two)) == [(2, "new", "added")]
