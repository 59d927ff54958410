"""Tables that a job writes for itself, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``.  Where that is unset, a local folder is set for the session if Spark runs on
    this machine alone (tests, a laptop); on a cluster it is an error, since no other folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``materialise`` and the folder, for tables that are removed once the next one is written."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    return stored(df, name)[0]


def remove_dir(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """The tables of one run, in one folder; ``finish`` leaves only the one that the result reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.paths = spark, shared_dir(spark, name), []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.place(df, name)[0]

    def place(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """``write`` and the table's folder, for ``remove_dir`` before the run ends."""
        path = f"{self.path}/{len(self.paths) + 1}-{name}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def measured(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """``write`` and aggregates of the rows, taken while they are written; None where there are no rows to take them of."""
        seen = Observation()
        done = self.write(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
        return done, seen.get

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes the run's result and removes its other tables."""
        done, path = self.place(df, name)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.listStatus(hadoop):
            if found.getPath().getName() != path.rsplit("/", 1)[-1]:
                files.delete(found.getPath(), True)
        return done


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until none of ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
