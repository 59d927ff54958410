"""Sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

DEALT = 8  #: tasks over which a batch's rows of one vault are dealt


def change_topics(changes: DataFrame, path: str, checkpoint: str, by: str = "vault_id") -> DataStreamWriter:
    """A writer that publishes a stream of changes under ``path``, by batch and vault; call ``start`` on it.

    A batch is committed whole or not at all, and one that is replayed after a failure replaces itself, so each change
    comes once.  Readers of a vault prune by its folder.
    """

    def commit(batch: DataFrame, number: int) -> None:
        batch.repartition(by, F.pmod(F.xxhash64(*batch.columns[:1]), F.lit(DEALT))).write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
