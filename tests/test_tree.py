import os

from pyspark.sql import functions as F

from quiltwork.operators.manifest import manifest_mismatches, task_counts, valid_train_counts
from quiltwork.operators.tree import TreeState, fan_in_rounds, tree_aggregate
from quiltwork.session import input_partitions, release, spread, staged

RAW = "row_id long, task_id string, source_file string, split string, source_index long, is_object boolean, inputs string, targets string, slot int"


def rows(spark, data):
    return spark.createDataFrame(data, RAW)


def test_rounds():
    assert [fan_in_rounds(n, 4) for n in (0, 1, 4, 5, 16, 17, 64)] == [1, 1, 1, 2, 2, 3, 3]


def test_tree_equals_group_by(spark):
    df = spark.range(0, 5000, numPartitions=37).select(F.when(F.col("id") % 3 < 2, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    tree = tree_aggregate(df, ["k"], [TreeState("n", F.count("*"), F.sum("n")), TreeState("s", F.sum("id"), F.sum("s"))], fan_in=3)
    flat = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    assert sorted(tree.collect()) == sorted(flat.collect())


def test_valid_counts_and_edges(spark):
    ok = (True, "in", "out", 0)
    data = [
        (1, "a", "f1", "train", 0, *ok), (2, "a", "f1", "train", 0, *ok), (3, "a", "f1", "train", 70000, *ok), (4, "a", "f1", "validation", 1, *ok),
        (5, "a", "f1", "train", 2, False, None, None, 0), (6, "a", "f1", "train", 3, True, " 　\x1c", "out", 0), (7, "a", "f1", "train", 4, True, "in", " ", 0),
        (8, "a", "f1", "train", 5, None, "in", "out", 0), (9, None, None, "train", 1, *ok), (10, "b", "f2", "train", None, *ok), (11, "b", "f2", "train", None, *ok), (12, "b", "f2", "train", -4, *ok), (13, "b", "f2", None, 1, *ok),
    ]
    got = {(r[0], r[1]): r[2] for r in valid_train_counts(rows(spark, data)).collect()}
    assert got == {("a", "f1"): 2, (None, None): 1, ("b", "f2"): 3}
    assert {r[0]: r[1] for r in task_counts(rows(spark, data)).collect()} == {"a": 2, None: 1, "b": 3}


def test_long_text_and_empty_table(spark):
    assert valid_train_counts(rows(spark, [])).collect() == []
    data = [(1, "a", "f", "train", 0, True, "x" * 2_000_000, " " * 100_000 + "y", 0)]
    assert valid_train_counts(rows(spark, data)).first()[2] == 1


def test_mismatches(spark):
    data = [(i, "a", f, "train", i, True, "in", "out", 0) for i, f in enumerate(["f1", "f1", "f2", "f3", "f5"])]
    manifest = spark.createDataFrame([("f1", 2, 9), ("f2", 5, 9), ("f3", None, 9), ("f4", 0, 9), ("f6", 1, 9)], "source_file string, valid_train_count long, source_index int")
    assert sorted(r[0] for r in manifest_mismatches(rows(spark, data), manifest).collect()) == ["f2", "f3", "f5", "f6"]
    assert manifest_mismatches(rows(spark, []), manifest.limit(0)).collect() == []


def test_states_not_rows_are_shuffled(spark):
    plan = valid_train_counts(rows(spark, [(1, "a", "f", "train", 0, True, "i", "o", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_bitmap_construct_agg") > plan.index("Exchange")


def test_partitions_from_planning(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    assert input_partitions(scan) == 1 and input_partitions(scan.groupBy("id").count()) == 4
    dealt = spread(scan)
    assert dealt.rdd.getNumPartitions() == 4 and sorted(r[0] for r in dealt.collect()) == list(range(100))
    many = spark.range(0, 100, 1, 9)
    assert spread(many) is many


def test_staged_tables_are_released(spark):
    a = staged(spark.range(5), "x")
    path = a._quiltwork_path.removeprefix("file:").replace("//", "/")
    assert a.count() == 5 and os.path.exists(path)
    release(a, spark.range(3))
    assert not os.path.exists(path)
