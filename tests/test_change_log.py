"""The change log as a stream: nothing lost or doubled over restarts, and pages of bounded size."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.sources.change_log import ChangeLog

SHAPE = "seq bigint, id bigint, at timestamp, content string, _run double"


def changes(spark, keys):
    rows = spark.createDataFrame([(s, i) for s, i in keys], "seq bigint, id bigint")
    return rows.select("seq", "id", F.timestamp_seconds(F.col("seq") * 1000 + 7).alias("at"), F.concat_ws("é", "seq", "id").alias("content"), F.lit(0.5).alias("_run"), F.lit("x").alias("more"))


def keys(rows):
    return Counter((r["seq"], r["id"]) for r in rows.collect())


def sunk(spark, stream, folder, fails=None):
    """Writes each batch to a folder of its own; a batch in ``fails`` breaks off once it is written."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        if fails and number in fails:
            fails.remove(number)
            raise RuntimeError("lost")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")


@pytest.mark.parametrize("folder", ["plain", "with space, % and #"])
def test_nothing_lost_or_doubled(spark, tmp_path, folder):
    r = random.Random(5)
    at = f"{tmp_path}/{folder}"
    log = ChangeLog(spark, f"{at}/log", SHAPE, rows_per_page=7)
    want, seq, fails = Counter(), 0, {3, 6}
    for number in range(4):
        new = []
        for _ in range(40):
            seq += r.choice([0, 1, 1, 3])
            new.append((seq, len(want) + len(new)))
        seq += 1
        r.shuffle(new)
        log.append(changes(spark, new), number)
        log.append(changes(spark, new), number)  # once more: changes nothing
        want += Counter(new)
        for _ in range(3):
            q = sunk(spark, log.stream(rows_per_batch=20), at, fails).start()
            try:
                q.processAllAvailable()
                break
            except Exception as error:  # noqa: BLE001
                assert "lost" in str(error)
            finally:
                q.stop()
        got = spark.read.parquet(f"{at}/out")
        assert keys(got) == want
    sizes = [row["count"] for row in got.groupBy("batch").count().collect()]
    assert max(sizes) < 20 + 7 and not fails
    assert all(x["content"] == f"{x['seq']}é{x['id']}" and x["s"] == x["seq"] * 1000 + 7 and x["_run"] == 0.5 for x in got.withColumn("s", F.unix_seconds("at")).collect())
    order = [x["b"] for x in got.groupBy("batch").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("batch").collect()]
    assert order == sorted(order)
    assert log.pages().agg(F.max("rows")).first()[0] <= 7


@pytest.mark.parametrize("bound", [0, 5])
def test_available_now_goes_on(spark, tmp_path, bound):
    log = ChangeLog(spark, f"{tmp_path}/log", SHAPE, rows_per_page=4)
    for number in range(3):
        log.append(changes(spark, [(number, i) for i in range(10)]), number)
    runs = []
    for _ in range(5):
        before = sum(runs)
        sunk(spark, log.stream(rows_per_batch=bound), tmp_path).trigger(availableNow=True).start().awaitTermination()
        runs.append(spark.read.parquet(f"{tmp_path}/out").count() - before)
    got = keys(spark.read.parquet(f"{tmp_path}/out"))
    assert max(got.values()) == 1
    assert runs == [30, 0, 0, 0, 0] if bound == 0 else max(runs) <= 8


def test_equal_rows_go_together(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", SHAPE, rows_per_page=2)
    rows = [(1, 1)] * 9 + [(1, 2)] * 3 + [(2, 1)]
    log.append(changes(spark, rows), 0)
    q = sunk(spark, log.stream(rows_per_batch=1), tmp_path).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert keys(got) == Counter(rows)
    assert got.select("seq", "id").distinct().count() == got.select("seq", "id", "batch").distinct().count()


def test_cursor_and_empty_log(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", SHAPE)
    assert log.version() == -1 and log.pages().count() == 0
    assert log.append(changes(spark, []), 4) == 4
    q = sunk(spark, log.stream(after=(3, 1)), tmp_path).start()
    q.processAllAvailable()
    log.append(changes(spark, [(3, 0), (3, 1), (3, 2), (-1, 9)]), 5)
    q.processAllAvailable()
    q.stop()
    assert keys(spark.read.parquet(f"{tmp_path}/out")) == Counter([(3, 2)])


def test_what_is_refused(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", SHAPE)
    log.append(changes(spark, [(5, 5)]), 0)
    for wrong in ([(5, 5)], [(4, 9), (7, 1)], [(None, 1)], [(9, None)]):
        with pytest.raises(ValueError):
            log.append(changes(spark, wrong), 1)
    assert log.version() == 0 and log.append(changes(spark, [(5, 6)]), 1) == 1
    assert log.pages().count() == 2
    with pytest.raises(ValueError):
        ChangeLog(spark, f"{tmp_path}/other", "seq int, id bigint")


def test_query_of_an_empty_table(spark, tmp_path):
    from folioflow.plans import QUERIES

    spark.createDataFrame([], "event_id bigint, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["change_log_stream"](spark, str(tmp_path)).collect() == []
