"""State of streamed folds: what is over goes, what counts stays."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import usage
from folioflow.streaming import folds

DAY = 86_400


def days(spark, folder):
    """A new set of users each day for six days, one user on all days, and a last day of another user alone; a file a day."""
    rows = []
    for d in range(6):
        rows += [(1000 * d + i, 10 * d + i % 5, d * DAY + 600 * i) for i in range(40)]
        rows += [(1000 * d + 100 + i, 999, d * DAY + 120 * i) for i in range(30)]
    rows.append((9000, 500, 9 * DAY))
    rows.append((9001, 500, 10 * DAY))
    all_ = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s bigint").select("event_id", "user_id", F.timestamp_seconds(F.col("s") + 20_000 * DAY).alias("ts"))
    for k, part in enumerate([f"event_id div 1000 = {d} AND event_id < 9000" for d in range(6)] + ["event_id = 9000", "event_id = 9001"]):
        all_.where(part).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return all_


@pytest.mark.parametrize("name, dials", [("conversation_meter", {"per_conversation": 4, "conversations": 3}), ("token_bucket", {"capacity": 5.0, "per_second": 0.004})])
def test_what_is_over_goes(spark, tmp_path, name, dials):
    rows = days(spark, tmp_path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    made = getattr(folds, name)(stream, late="1 hour", **dials)
    q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, getattr(usage, name)(rows, **dials).collect()))
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/cp")
    users = {r[0] for r in held.select("key.*").collect()}
    assert users == {500}


def test_another_store_is_an_error(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS event_id", "value AS user_id", "timestamp AS ts")
    before = spark.conf.get(folds.STORE)
    spark.conf.set(folds.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError):
            folds.token_bucket(stream)
    finally:
        spark.conf.set(folds.STORE, before)
