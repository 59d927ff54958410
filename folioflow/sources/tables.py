"""Reading and writing tables: Parquet folders, binary files, partitioned and replacing sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """A Parquet table; named columns and simple conditions reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def blobs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def write_by_vault(df: DataFrame, path: str, by: str = "vault_id", rows_per_file: int = 1_000_000) -> None:
    """A folder for each vault, so that a tenant's condition prunes files; a large vault is written by several tasks."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "context_text", batch: int = 128) -> DataFrame:
    """``chunks`` with a column dense from ``embed``, which takes texts in batches and keeps their order."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*chunks.schema.fields, StructField("dense", ArrayType(FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for k in range(0, len(frame), batch):
                vectors += embed(frame[text].iloc[k : k + batch].tolist())
            yield frame.assign(dense=vectors)

    return chunks.mapInPandas(run, schema)
