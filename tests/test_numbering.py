import os
import random

from pyspark.sql import functions as F

from folioflow.operators.numbering import numbered
from folioflow.scratch import Scratch


def test_numbers_of_the_whole_table_and_of_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), r.randint(0, 50), i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "vault string, score int, id int, _at string").repartition(5)
    got = numbered(df, [F.desc("score"), F.col("id")], "n").collect()
    want = sorted(rows, key=lambda x: (-x[1], x[2]))
    assert [tuple(x)[:4] for x in sorted(got, key=lambda x: x.n)] == want and sorted(x.n for x in got) == list(range(1, 2001))
    got = numbered(df, [F.col("score"), F.col("id")], "n", ["vault"]).collect()
    for vault in "a", "b", "c", None:
        mine = sorted((x.n, x.id) for x in got if x.vault == vault)
        assert mine == list(enumerate((x[2] for x in sorted((x for x in rows if x[0] == vault), key=lambda x: x[1:3])), 1))


def test_one_group_and_equal_rows_fill_many_ranges(spark):
    df = spark.range(40_000).select(F.lit("v").alias("vault"), F.lit(7).alias("score")).repartition(8)
    table = Scratch(spark, "test").write(df, "equal")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1m"}
    for k, v in held.items():
        spark.conf.set(k, v)
    got = numbered(table, [F.col("score")], "n", ["vault"], spread=True)
    assert sorted(x.n for x in got.collect()) == list(range(1, 40_001))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(x["count"] for x in tasks) < 15_000
    for k in held:
        spark.conf.unset(k)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "_at int, _part int, _tie int")
    assert numbered(df, [F.col("_at")], "n", ["_part"]).columns == ["_at", "_part", "_tie", "n"]
    assert numbered(df, [F.col("_at")], "n", ["_part"], spread=True).count() == 0
    one = numbered(spark.createDataFrame([(None, None)], "_at int, _before int"), [F.col("_at")], "n", ["_before"]).collect()
    assert [tuple(x) for x in one] == [(None, None, 1)]


def test_a_run_leaves_its_result_only(spark):
    run = Scratch(spark, "test")
    first = run.write(spark.range(5), "first")
    again, seen = run.measured(first.where("id > 2"), "again", rows=F.count("*"), most=F.max("id"))
    none, empty = run.measured(again.where("id > 9"), "none", rows=F.count("*"), most=F.max("id"))
    bare, nothing = run.measured(spark.createDataFrame([], "id int"), "bare", rows=F.count("*"), most=F.max("id"))
    assert again.count() == 2 and seen == {"rows": 2, "most": 4} and empty == nothing == {"rows": 0, "most": None} and none.isEmpty() and bare.isEmpty()
    done = run.finish(first.withColumn("two", F.lit(2)))
    assert done.count() == 5
    assert os.listdir(run.path.removeprefix("file://")) == ["5-result"]
