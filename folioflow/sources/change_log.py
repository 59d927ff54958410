"""A log of changes in the order of (seq, id), and a streaming source that reads it from a cursor.

Changes lie in immutable Parquet files, each a run of the order with at most ``rows_per_page`` rows.  An append has a number
and is applied once; it is committed by renaming a small manifest, one row a file with its first and last (seq, id), so a
reader sees an append as a whole or not at all.  Cursors only move on, so an append must lie behind all earlier ones.

As a stream (format ``change_log``) the offset is the (seq, id) of the last change read.  A page, which is a file or the part
of one behind the cursor, is a task; rows stream through it in Arrow batches.  The driver reads manifests, never changes.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

ROWS_PER_PAGE = 500_000
BATCH_ROWS = 8_192  #: rows of one Arrow batch

Key = tuple[int, int]


class ChangeLog:
    """``changes`` given to ``append`` hold ``schema``, in which seq and id are bigint."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, rows_per_page: int = ROWS_PER_PAGE):
        self.spark, self.rows_per_page = spark, rows_per_page
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        given = self._path(root)
        self._files = given.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._files.makeQualified(given).toString().rstrip("/")  # executors and the driver's readers ask the same file system
        self.schema = spark.createDataFrame([], schema).schema
        for key in ("seq", "id"):
            if key not in self.schema.names or self.schema[key].dataType != LongType():
                raise ValueError(f"{key} must be a column of type bigint")

    def version(self) -> int:
        """The last append that was committed; -1 without any."""
        folder = self._path(f"{self.root}/versions")
        found = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return max((int(n) for n in found if n.isdigit()), default=-1)

    def append(self, changes: DataFrame, batch: int) -> int:
        """Adds changes and returns the version; a number that was applied before, or a smaller one, changes nothing.

        A change without seq or id, or one that isn't behind all earlier appends, is a ValueError and nothing is added.
        Rows equal in (seq, id) all stay.  An empty append only takes its number.
        """
        version = self.version()
        if batch <= version:
            return version
        if version < 0:
            self._write_text(f"{self.root}/schema.json", self.schema.json())
        name = f"{batch}-{uuid.uuid4().hex}"
        folder = f"{self.root}/data/{name}"
        changes.select(*self.schema.names).repartitionByRange("seq", "id").sortWithinPartitions("seq", "id").write.option("maxRecordsPerFile", self.rows_per_page).parquet(folder)
        written = self.spark.read.schema(self.schema).parquet(folder)
        key, file = F.struct("seq", "id"), F.concat(F.lit(f"{name}/"), written.metadataColumn("_metadata")["file_name"]).alias("file")
        nulls = F.count_if(F.col("seq").isNull() | F.col("id").isNull()).alias("nulls")
        temporary, final = f"{self.root}/versions/_{uuid.uuid4().hex}", f"{self.root}/versions/{batch}"
        written.groupBy(file).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"), nulls).coalesce(1).write.parquet(temporary)
        first, bad = self.spark.read.parquet(temporary).agg(F.min("first"), F.sum("nulls")).first()
        last, wrong = self._last(), None
        if bad:
            wrong = "changes without seq or id"
        elif first is not None and last is not None and tuple(first) <= last:
            wrong = f"changes up to {last} are in the log already"
        if wrong:
            self._files.delete(self._path(folder), True)
            self._files.delete(self._path(temporary), True)
            raise ValueError(wrong)
        if not self._files.rename(self._path(temporary), self._path(final)):
            raise FileExistsError(final)
        return batch

    def pages(self) -> DataFrame:
        """file, first, last and rows of all pages."""
        schema = "file string, first struct<seq: bigint, id: bigint>, last struct<seq: bigint, id: bigint>, rows bigint"
        version = self.version()
        if version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.getPath().toString() for s in self._files.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName().isdigit()])

    def stream(self, rows_per_batch: int = 0, after: Key | None = None) -> DataFrame:
        """The changes behind ``after`` (the first run's; later ones go on from their checkpoint) as a streaming DataFrame.

        A batch ends with the page that brings it to ``rows_per_batch`` rows; 0 takes all that is there.  A run with the
        trigger ``availableNow`` asks for the end once, so with a bound it is one batch.
        """
        self.spark.dataSource.register(ChangeLogSource)
        reader = self.spark.readStream.format("change_log").schema(self.schema).option("path", self.root).option("rows_per_batch", str(rows_per_batch))
        if after is not None:
            reader = reader.option("after_seq", str(after[0])).option("after_id", str(after[1]))
        return reader.load()

    def _last(self) -> Key | None:
        found = self.pages().agg(F.max("last")).first()[0]
        return tuple(found) if found is not None else None

    def _write_text(self, path: str, text: str) -> None:
        out = self._files.create(self._path(path), True)
        out.write(bytearray(text, "utf-8"))
        out.close()


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a qualified folder, whose characters are taken as they are."""
    scheme, colon, rest = root.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        return pafs.LocalFileSystem(), "/" + (rest if scheme == "file" else root).lstrip("/")
    authority, _, path = rest.lstrip("/").partition("/")
    files, base = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return files, f"{base.rstrip('/')}/{path}"


@dataclass
class Page(InputPartition):
    """The changes of one file behind ``start`` and up to ``end``; None where the file's own end is nearer."""

    file: str
    start: Key | None
    end: Key | None


@dataclass(frozen=True)
class Span:
    first: Key
    last: Key
    rows: int
    file: str


class ChangeLogSource(DataSource):
    """Options: path, rows_per_batch (0: all), after_seq and after_id (a new stream begins behind them)."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> StructType:
        files, root = opened(self.options["path"])
        with files.open_input_stream(f"{root}/schema.json") as stored:
            return StructType.fromJson(json.loads(stored.read()))

    def streamReader(self, schema: StructType) -> ChangeLogReader:
        return ChangeLogReader(self.options["path"], schema, int(self.options.get("rows_per_batch", 0)), int(self.options.get("after_seq", -(2**63))), int(self.options.get("after_id", -(2**63))))


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, root: str, schema: StructType, rows_per_batch: int, seq: int, id_: int):
        self.root, self.schema, self.rows_per_batch, self.begin = root, schema, rows_per_batch, (seq, id_)
        self.at: Key | None = None  #: up to where batches have been planned
        self.spans: list[Span] = []
        self.known: set[str] = set()

    def initialOffset(self) -> dict:
        return {"seq": self.begin[0], "id": self.begin[1]}

    def latestOffset(self) -> dict:
        """The end of the next batch.  Spark plans the last batch of a resumed stream first, which tells where it stands."""
        self._refresh()
        at = self.begin if self.at is None else self.at
        left = self.spans[self._behind(at) :]
        if not left:
            return {"seq": at[0], "id": at[1]}
        end, rows = left[-1].last, 0
        for span, following in zip(left, [*left[1:], None], strict=True):
            rows += span.rows
            whole = following is None or following.first > span.last  # rows equal in (seq, id) go together
            if self.rows_per_batch and rows >= self.rows_per_batch and whole:
                end = span.last
                break
        self.at = end
        return {"seq": end[0], "id": end[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        begin, stop = (start["seq"], start["id"]), (end["seq"], end["id"])
        if stop < begin:
            raise ValueError(f"the stream has been read up to {begin} and can't end at {stop}")
        self.at = stop if self.at is None else max(self.at, stop)
        if begin == stop:
            return []
        self._refresh()
        return [Page(s.file, begin if s.first <= begin else None, stop if s.last > stop else None) for s in self.spans[self._behind(begin) :] if s.first <= stop]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.root)
        shape = pads.ParquetFileFormat(coerce_int96_timestamp_unit="us")
        rows = pads.dataset(f"{root}/data/{partition.file}", filesystem=files, format=shape)
        wanted = to_arrow_schema(self.schema)
        seq, id_, kept = pads.field("seq"), pads.field("id"), None
        if partition.start is not None:
            kept = (seq > partition.start[0]) | ((seq == partition.start[0]) & (id_ > partition.start[1]))
        if partition.end is not None:
            below = (seq < partition.end[0]) | ((seq == partition.end[0]) & (id_ <= partition.end[1]))
            kept = below if kept is None else kept & below
        for batch in rows.scanner(columns=self.schema.names, filter=kept, batch_size=BATCH_ROWS, batch_readahead=1, fragment_readahead=1).to_batches():
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()

    def _behind(self, at: Key) -> int:
        """The first page that ends behind a cursor."""
        return bisect_right(self.spans, at, key=lambda s: s.last)

    def _refresh(self) -> None:
        """Takes in the manifests that have come since."""
        files, root = opened(self.root)
        folders = files.get_file_info(pafs.FileSelector(f"{root}/versions", allow_not_found=True))
        new = sorted((f.base_name for f in folders if f.base_name.isdigit() and f.base_name not in self.known), key=int)
        for name in new:
            rows = pads.dataset(f"{root}/versions/{name}", filesystem=files, format="parquet").to_table().to_pylist()
            found = [Span((r["first"]["seq"], r["first"]["id"]), (r["last"]["seq"], r["last"]["id"]), r["rows"], r["file"]) for r in rows]
            self.spans += sorted(found, key=lambda s: (s.last, s.first))
            self.known.add(name)
