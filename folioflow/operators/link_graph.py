"""The link graph kept as a table: a batch of changed files touches only the edges of the names that it concerns.

Three tables that take numbered batches (``UpsertTable``).  ``edges`` holds resolved edges by the basename they ask for,
``files`` the live files by their basename, ``names`` the basenames that each note asks for.  A file that comes, goes or
moves can change only edges of its old and its new basename; a note whose text changes only those of the names it asked for
and asks for now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import links
from folioflow.scratch import Scratch, remove_dir
from folioflow.sources.upsert import UpsertTable

FILES = "vault_id string, basename_key string, id bigint, kind string, path string"
NAMES = "vault_id string, note_id bigint, basename_key string"
EDGES = (
    "vault_id string, basename_key string, source_note_id bigint, position int, target string, target_raw string, target_start int, target_len int, alias string, anchor string, "
    "link_type string, form string, target_note_id bigint, target_attachment_id bigint, target_path string, dangling boolean"
)
KEY = ["vault_id", "basename_key"]


class LinkGraph:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, root = spark, root.rstrip("/")
        self.edges = UpsertTable(spark, f"{root}/edges", EDGES, bucket_on="basename_key", buckets=buckets)
        self.names = UpsertTable(spark, f"{root}/names", NAMES, bucket_on="note_id", buckets=buckets)
        self.files = UpsertTable(spark, f"{root}/files", FILES, bucket_on="basename_key", buckets=buckets)

    def apply(self, files: DataFrame, contents: DataFrame, batch: int) -> int:
        """Takes a batch in and returns its number; a batch that was taken before changes nothing.

        ``files`` has a row for each file that came, went or moved: vault_id, id, kind (note or attachment), old_path (null:
        it came) and path (null: it went), the whole batch's change in one row.  ``contents`` has vault_id, note_id and
        content of the notes whose text is new.  A note that goes takes its own edges along; edges to it fall to another file
        of that name or dangle.  Null contents have no links.  The edges are committed first and the files last, and each is
        made from what was before the batch, so a batch that broke off is taken in by giving it again.
        """
        run = Scratch(self.spark, "link-graph")
        try:
            changed = run.write(files.select("vault_id", F.col("id").cast("bigint").alias("id"), "kind", "old_path", "path"), "changes")
            gone = changed.where("kind = 'note' AND path IS NULL").select("vault_id", F.col("id").alias("note_id"))
            anew = run.write(contents.select("vault_id", F.col("note_id").cast("bigint").alias("note_id"), "content").join(gone, ["vault_id", "note_id"], "left_anti"), "contents")
            replaced = run.write(gone.unionByName(anew.select("vault_id", "note_id")).distinct(), "notes")
            asked = run.write(links.extract_links(anew), "links")
            moved = F.explode(F.array_compact(F.array("old_path", "path")))
            renamed = run.write(changed.select("vault_id", moved.alias("p")).select("vault_id", T.basename_key(F.col("p")).alias("basename_key")).distinct(), "renamed")
            named = lambda path: changed.where(F.col(path).isNotNull()).select("vault_id", T.basename_key(F.col(path)).alias("basename_key"), "id", "kind", F.col(path).alias("path"))
            if self.edges.version() < batch:
                left = self.names.rows_of(replaced).join(replaced, ["vault_id", "note_id"], "left_semi")
                keys = run.write(renamed.unionByName(left.select(*KEY)).unionByName(asked.select(*KEY)).distinct(), "keys")
                live = self._after(self.files.rows_of(keys).join(keys, KEY, "left_semi"), changed).unionByName(named("path").join(keys, KEY, "left_semi"))
                held = self.edges.rows_of(keys).join(keys, KEY, "left_semi")
                held = held.join(replaced.withColumnRenamed("note_id", "source_note_id"), ["vault_id", "source_note_id"], "left_anti")
                now = held.select(*asked.columns).unionByName(asked)
                self.edges.replace(keys, links.resolve(now, live), batch)
            if self.names.version() < batch:
                self.names.replace(replaced, asked.select("vault_id", F.col("source_note_id").alias("note_id"), "basename_key").distinct(), batch)
            if self.files.version() < batch:
                live = self._after(self.files.rows_of(renamed).join(renamed, KEY, "left_semi"), changed).unionByName(named("path"))
                self.files.replace(renamed, live, batch)
            return batch
        finally:
            remove_dir(self.spark, run.path)

    def _after(self, files: DataFrame, changed: DataFrame) -> DataFrame:
        """Files but for those that changed."""
        return files.join(changed.select("vault_id", "id", "kind"), ["vault_id", "id", "kind"], "left_anti").select("vault_id", "basename_key", "id", "kind", "path")
