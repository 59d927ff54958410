"""A table of vectors with payloads that takes batches of upserts: only the buckets that a batch touches are written anew.

Rows lie in folders by vault, bucket (a hash of what they are replaced by, so a large vault has many) and the batch that wrote
the folder.  A version is a small manifest, one row for each vault and bucket, that names the batch to read; it is committed
by one rename, so a reader sees a whole version, and files of older versions stay until ``vacuum``.  A batch has a number and
is applied once: the same or an earlier one again changes nothing, which is what a stream's ``foreachBatch`` needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

BUCKETS = 64


class UpsertTable:
    """``schema`` must hold ``vault`` and ``bucket_on``; the columns _bucket and _batch are the table's own."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, vault: str = "vault_id", bucket_on: str = "note_id", buckets: int = BUCKETS):
        self.spark, self.root, self.vault, self.bucket_on, self.buckets = spark, root.rstrip("/"), vault, bucket_on, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.parts = [vault, "_bucket"]

    def _files(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The last batch that was committed; -1 without any."""
        files, path = self._files()
        folder = path(f"{self.root}/versions")
        found = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n) for n in found if n.isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> DataFrame:
        """vault, _bucket and _batch of the folders that a version reads."""
        version = self.version() if version is None else version
        schema = f"`{self.vault}` {self.schema[self.vault].dataType.simpleString()}, _bucket int, _batch bigint"
        return self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}") if version >= 0 else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a condition on the vault prunes folders."""
        return self._current(self.manifest(version)).select(*self.schema.names)

    def _current(self, manifest: DataFrame) -> DataFrame:
        stored = StructType([*(f for f in self.schema.fields if f.name != self.vault), self.schema[self.vault]]).add("_bucket", IntegerType()).add("_batch", LongType())
        if not self._files()[0].exists(self._files()[1](f"{self.root}/data")):
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(f"{self.root}/data")
        same = [rows[c].eqNullSafe(manifest[c]) for c in (*self.parts, "_batch")]
        return rows.join(manifest, same[0] & same[1] & same[2], "left_semi")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.bucket_on), F.lit(self.buckets)).cast("int"))

    def upsert(self, rows: DataFrame, batch: int, on: Sequence[str] = ()) -> int:
        """Puts ``rows`` in place of those with the same vault and ``on``; returns the version.

        ``on`` holds the column ``bucket_on``, which it is by default: then a note's rows are replaced as wholes, otherwise
        row by row, and of several new rows with one key the largest stays.  Null keys are equal.
        """
        keys = [self.vault, *(on or [self.bucket_on])]
        if self.bucket_on not in keys:
            raise ValueError(f"rows are found by {self.bucket_on}")
        new = self._bucketed(rows.select(*self.schema.names))
        if on:
            new = new.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.max(F.struct(*new.columns)).alias("r")).select("r.*")
        return self._apply(new.select(*keys).distinct(), keys, new, batch)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The current rows of the buckets that ``keys`` (with ``bucket_on``) fall into; other folders aren't read."""
        touched = sorted(r["_bucket"] for r in self._bucketed(keys.select(self.bucket_on)).select("_bucket").distinct().collect())  # at most ``buckets``
        return self._current(self.manifest().where(F.col("_bucket").isin(touched))).where(F.col("_bucket").isin(touched)).select(*self.schema.names)

    def replace(self, gone: DataFrame, rows: DataFrame, batch: int) -> int:
        """Puts ``rows`` in place of all those with the values of ``gone``, which names every key that ``rows`` has."""
        return self._apply(gone.distinct(), gone.columns, self._bucketed(rows.select(*self.schema.names)), batch)

    def delete(self, keys: DataFrame, batch: int) -> int:
        """Takes the rows with these values (the columns of ``keys``: vault and ``bucket_on``, or more) away."""
        return self._apply(keys.distinct(), keys.columns, None, batch)

    def _apply(self, gone: DataFrame, keys: Sequence[str], new: DataFrame | None, batch: int) -> int:
        version = self.version()
        if batch <= version:
            return version
        before = self.manifest(version)
        touched = self._bucketed(gone).select(*self.parts).distinct()
        same = lambda a, b, columns: [a[c].eqNullSafe(b[c]) for c in columns]
        both = lambda conditions: conditions[0] if len(conditions) == 1 else conditions[0] & both(conditions[1:])
        held = self._current(before.join(touched, both(same(before, touched, self.parts)), "left_semi"))
        left = held.join(gone, both(same(held, gone, keys)), "left_anti").drop("_batch")
        after = left if new is None else left.unionByName(new.select(*left.columns))
        dealt = after.withColumn("_batch", F.lit(batch).cast("bigint")).hint("rebalance", *self.parts)  # a bucket of very many rows fills several tasks and files
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts, "_batch").parquet(f"{self.root}/data")
        manifest = before.join(touched, both(same(before, touched, self.parts)), "left_anti").unionByName(touched.withColumn("_batch", F.lit(batch).cast("bigint")))
        files, path = self._files()
        temporary, final = f"{self.root}/versions/_{uuid.uuid4().hex}", f"{self.root}/versions/{batch}"
        manifest.write.parquet(temporary)
        if not files.rename(path(temporary), path(final)):
            raise FileExistsError(final)
        return batch

    def vacuum(self) -> int:
        """Removes the folders that the last version doesn't read, and older manifests; returns how many folders went."""
        version = self.version()
        files, path = self._files()
        if version < 0:
            return 0
        rows = self.spark.read.parquet(f"{self.root}/data")
        current = self.manifest(version)
        folder = F.regexp_replace(rows.metadataColumn("_metadata")["file_path"], "/[^/]*$", "")
        kept = F.broadcast(current) if current.count() <= 1_000_000 else current
        old = rows.join(kept, [rows[c].eqNullSafe(current[c]) for c in (*self.parts, "_batch")], "left_anti").select(folder.alias("folder")).distinct()
        gone = 0
        for row in old.toLocalIterator():  # a folder at a time
            gone += files.delete(path(self.spark._jvm.java.net.URI(row["folder"])), True)
        for status in files.listStatus(path(f"{self.root}/versions")):
            if status.getPath().getName() != str(version):
                files.delete(status.getPath(), True)
        return gone
