"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A store is a folder with ``data/`` (shards, never changed once written) and ``manifests/`` (one Parquet folder for each
version, which lists the live shards with their rows, bytes and tier).  Arrivals are appended as they come, as many
small shards.  A compaction takes the tiers (powers of FAN_IN times the smallest size) that hold FAN_IN shards or more,
packs each tier's shards in the order of their arrival into groups of about the target size, and rewrites each group as
one shard.  A shard of the target size is left alone, so each row is rewritten a logarithmic number of times.

A version is committed by renaming its manifest, written under a temporary name, to ``v<number>``; the rename fails if
that version exists, so of two writers one loses and must begin again from the new version.  Readers keep the version
that they began with: nothing is deleted before ``vacuum``.

Rows are moved by Spark's own readers and writers alone; plans and manifests have a row for each shard, not for each row,
and are DataFrames.  A round takes about ROUND_SHARDS shards at most, so that what it lists on the driver is bounded; rows
go straight to the task of their group, which writes one shard.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import free_name

TARGET_BYTES = 128 << 20
FAN_IN = 4
SMALLEST = 64 << 10  #: bytes up to which a shard is in tier 0
ARRIVAL_ROWS = 2_000  #: rows of an arriving shard at most
GROUP_SHARDS = 10_000  #: shards of a group at most
ROUND_SHARDS = 100_000  #: shards that a round merges, about; further rounds take the rest
STRETCH_SHARDS = 20_000  #: of a tier that are summed up in one task, about
MANIFEST_ROWS = 1_000_000  #: of a file of a manifest

#: ``siblings``: how many shards were written to the shard's folder
MANIFEST = "shard string, n_rows bigint, n_bytes bigint, tier int, added bigint, siblings bigint"
_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def tier(n_bytes: Column, fan_in: int = FAN_IN) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(n_bytes, F.lit(1)) / SMALLEST) / F.log(F.lit(float(fan_in))))).cast("int")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _tail(path: Column) -> Column:
    """Folder and file name, which are the same however a file system writes the rest of a path."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def _plain(uri: Column) -> Column:
    """The path in a file's URI, as readers take it: blanks, ``%`` and ``#`` are themselves again."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


class ShardStore:
    """A store at ``root``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop
        self._files = self._hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions -----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        path = self._hadoop.fs.Path(f"{self.root}/manifests")
        if not self._files.exists(path):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in self._files.listStatus(path) if s.getPath().getName().startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        """Makes ``manifest`` the given version; raises FileExistsError if another writer was first."""
        temporary, final = f"{self.root}/manifests/_{uuid.uuid4().hex}", f"{self.root}/manifests/v{version}"
        manifest.repartition(1 + manifest.count() // MANIFEST_ROWS).write.parquet(temporary)
        path = self._hadoop.fs.Path
        context = self._hadoop.fs.FileContext.getFileContext(path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.NONE
        if self._files.exists(path(final)):
            self._files.delete(path(temporary), True)
            raise FileExistsError(final)
        try:
            context.rename(path(temporary), path(final), options)
        except Exception as error:
            self._files.delete(path(temporary), True)
            if self._files.exists(path(final)):
                raise FileExistsError(final) from error
            raise
        return version

    def _listed(self, folder: str, version: int) -> DataFrame:
        """The shards in a data folder with their rows and bytes; empty files are no shards."""
        files = self.spark.read.parquet(folder)
        meta = files.metadataColumn("_metadata")
        meta = files.select(_plain(meta["file_path"]).alias("shard"), meta["file_size"].alias("n_bytes"))
        found = meta.groupBy("shard").agg(F.count("*").alias("n_rows"), F.max("n_bytes").alias("n_bytes"))
        found = found.withColumn("tier", tier(F.col("n_bytes"), self.fan_in)).withColumn("added", F.lit(version).cast("bigint"))
        return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("siblings")))).select(*_COLUMNS)  # one row

    # --- operations ---------------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Writes ``rows`` as small shards and commits them; returns the version.  No rows, no new version."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        version = self.version() + 1
        rows.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(folder)
        listed = self._listed(folder, version)
        if version == 1 and listed.isEmpty():
            return 0
        if listed.isEmpty():
            return version - 1
        return self._commit(self.manifest(version - 1).unionByName(listed), version)

    def plan(self, version: int | None = None) -> DataFrame:
        """shard and the ``group`` that it is to be merged into, for the live shards that are due.

        Groups are numbered from 0, by tier and arrival.  A tier is summed up stretch by stretch: its shards by version and
        hash, then the stretches' totals, so no task sorts a whole tier.
        """
        small = self.manifest(version).where(F.col("n_bytes") * 2 <= self.target)
        tiers = {r["tier"]: r["n"] for r in small.groupBy("tier").agg(F.count("*").alias("n")).collect() if r["n"] >= self.fan_in}  # a row for each power
        due = small.where(F.col("tier").isin(list(tiers))).withColumn("cost", F.greatest("n_bytes", F.lit(self.target // GROUP_SHARDS)))
        stretches = 1 + max(tiers.values(), default=0) // STRETCH_SHARDS
        due = due.withColumn("stretch", F.pmod(F.xxhash64("shard"), F.lit(stretches)))
        key = ["tier", "added", "stretch"]
        totals = due.groupBy(*key).agg(F.sum("cost").alias("total"))
        earlier = Window.partitionBy("tier").orderBy("added", "stretch").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*key, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
        inside = Window.partitionBy(*key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        slot = F.floor((F.col("before") + F.coalesce(F.sum("cost").over(inside), F.lit(0))) / self.target)
        due = due.join(totals, key).withColumn("slot", slot)
        groups = due.groupBy("tier", "slot").agg(F.count("*").alias("n")).where("n > 1")  # a row for each target
        groups = groups.withColumn("group", (F.row_number().over(Window.orderBy("tier", "slot")) - 1).cast("int"))
        groups = groups.withColumn("through", F.sum("n").over(Window.orderBy("group")))
        return due.join(groups, ["tier", "slot"]).select("shard", "n_rows", "n_bytes", "group", "through")

    def compact(self) -> int:
        """One round; returns the version after it, which is the old one when nothing is due."""
        version = self.version()
        due = self.plan(version).where((F.col("group") == 0) | (F.col("through") <= ROUND_SHARDS)).select("shard", "group")
        listed = due.collect()  # at most ROUND_SHARDS, or one group
        if not listed:
            return version
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows = self.spark.read.parquet(*[r["shard"] for r in listed])
        columns = rows.columns
        file, group = free_name(columns, "file"), free_name(columns, "group")
        pairs = self.spark.createDataFrame([(r["shard"], r["group"]) for r in listed], f"`{file}` string, `{group}` int")
        rows = rows.withColumn(file, _plain(rows.metadataColumn("_metadata")["file_path"])).join(F.broadcast(pairs), file)
        dealt = rows.repartitionById(max(r["group"] for r in listed) + 1, F.col(group)).select(*[F.col(f"`{c}`") for c in columns])
        dealt.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folder)
        merged = self._listed(folder, version + 1)
        old = self.manifest(version).join(F.broadcast(pairs.select(F.col(file).alias("shard"))), "shard", "left_anti")
        return self._commit(old.select(*_COLUMNS).unionByName(merged), version + 1)

    def compact_fully(self) -> int:
        """Rounds until nothing is due."""
        before = -1
        while before != (now := self.compact()):
            before = now
        return now

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version.  Folders whose shards are all live are read whole, others shard by shard."""
        shards = self.manifest(version).withColumn("folder", _folder(F.col("shard")))
        whole = shards.groupBy("folder").agg(F.count("*").alias("n"), F.max("siblings").alias("siblings")).where("n = siblings").select("folder")
        single = shards.join(whole, "folder", "left_anti").select("shard")
        paths = [r[0] for r in whole.unionByName(single.toDF("folder")).collect()]  # a round leaves few behind
        if not paths:
            raise FileNotFoundError(f"{self.root} has no rows")
        blocks = [paths[k : k + ROUND_SHARDS] for k in range(0, len(paths), ROUND_SHARDS)]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(*block) for block in blocks])

    def vacuum(self) -> int:
        """Deletes files that the newest version doesn't list; returns how many.  Older versions can't be read then."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        files = reader.load(f"{self.root}/data").select("path", _tail(F.col("path")).alias("tail"))  # listed, not opened
        live = self.manifest().select(_tail(F.col("shard")).alias("tail"))
        gone = 0
        for row in files.join(live, "tail", "left_anti").select("path").toLocalIterator():
            gone += self._files.delete(self._hadoop.fs.Path(row["path"]), False)
        return gone


def compacted(rows: DataFrame, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Appends ``rows`` to a new store at ``root``, compacts it fully and returns all its rows, read from the newest version.

    Nulls, empty texts, repeated rows and all columns are kept as they are, whatever their names; an empty table comes back
    as it is.
    """
    store = ShardStore(rows.sparkSession, root, target_bytes, fan_in)
    if not store.append(rows):
        return rows.limit(0)
    store.compact_fully()
    store.vacuum()
    return store.read().select(*[F.col(f"`{c}`") for c in rows.columns])


#: What the query returns, in DuckDB's SQL.
SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
