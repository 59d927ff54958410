"""Change feeds: sequence numbers, keyset pages, byte budgets, merged feeds, manifests, folder trees, batch changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.numbering import numbered

MAX_PAGE = 500


def live(df: DataFrame, user: object = None, vault: object = None) -> DataFrame:
    """Rows that aren't deleted, of one tenant where given; as a filter on a partition column it prunes files."""
    df = df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df
    df = df.where(F.col("user_id") == F.lit(user)) if user is not None else df
    return df.where(F.col("vault_id") == F.lit(vault)) if vault is not None else df


def with_seq(changes: DataFrame, order: Sequence[str], by: str = "vault_id") -> DataFrame:
    """A sequence number for each change of a vault, in the order given; a vault of any size is numbered by many tasks."""
    return numbered(changes, [F.col(c) for c in order], "seq", [by])


def after(seq: int, id_: object = None) -> Column:
    """The keyset condition: later than (seq, id); without an id, than seq alone."""
    return F.col("seq") > seq if id_ is None else (F.col("seq") > seq) | ((F.col("seq") == seq) & (F.col("id") > F.lit(id_)))


def page(changes: DataFrame, seq: int, id_: object, limit: int, budget: int | None = None, size: str = "content_bytes") -> DataFrame:
    """The next changes after a cursor, with has_more; at most ``limit`` and MAX_PAGE rows.

    With a budget, the longest beginning whose sizes sum up to it; the first change always ships.  One row more than the
    page is read to know whether there are more; a page fits in one task.
    """
    limit = min(max(limit, 1), MAX_PAGE)
    rows = changes.where(after(seq, id_)).orderBy("seq", "id").limit(limit + 1)
    order = Window.orderBy("seq", "id")
    rows = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    fits = F.col("_r") <= limit
    if budget is not None:
        spent = F.sum(F.coalesce(F.col(size), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        fits = fits & ((spent <= budget) | (F.col("_r") == 1))
    kept = rows.withColumn("_f", fits).withColumn("_k", F.count_if("_f").over(Window.partitionBy()))
    return kept.where("_f").select(*changes.columns, (F.col("_n") > F.col("_k")).alias("has_more"))


def merged_page(feeds: Sequence[DataFrame], seq: int, id_: object, limit: int, budgets: Sequence[int | None] = ()) -> DataFrame:
    """One page of several feeds in the order of (seq, id), with has_more.

    A feed that has more than its page only vouches for changes up to its last one; the merged page ends at the smallest
    of those, so no change is passed over.
    """
    limit = min(max(limit, 1), MAX_PAGE)
    budgets = list(budgets) or [None] * len(feeds)
    parts = [page(f, seq, id_, limit + 1, b).withColumn("_feed", F.lit(i)) for i, (f, b) in enumerate(zip(feeds, budgets, strict=True))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    ends = both.where("has_more").groupBy("_feed").agg(F.max(F.struct("seq", "id")).alias("last")).agg(F.min("last").alias("mark"))
    held = both.join(F.broadcast(ends)).where(F.col("mark").isNull() | (F.struct("seq", "id") <= F.col("mark")))
    order = Window.orderBy("seq", "id")
    counted = held.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    more = (F.col("_n") > limit) | F.col("mark").isNotNull()
    return counted.where(F.col("_r") <= limit).select(*[c for c in both.columns if c not in ("has_more", "_feed")], more.alias("has_more"))


def catch_up(feeds: Sequence[DataFrame], cursor: str, limit: int, budgets: Sequence[int | None] = ()) -> DataFrame:
    """A merged page after a cursor ``seq`` or ``seq:id``; an id that is no number counts as none."""
    seq, _, id_ = cursor.partition(":")
    return merged_page(feeds, int(seq), int(id_) if id_.lstrip("-").isdigit() else None, limit, budgets)


def manifest(notes: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """kind, id, path, content_hash and seq of all live files, by path."""
    columns = ["id", "path", "content_hash", "seq"]
    rows = live(notes).select(F.lit("note").alias("kind"), *columns)
    if attachments is not None:
        rows = rows.unionByName(live(attachments).select(F.lit("attachment").alias("kind"), *columns))
    return rows.orderBy("path", "kind", "id")


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """key and status (added, removed, changed) of what differs between two manifests; one full join on the key."""
    a, b = old.select(F.col(key), F.col("content_hash").alias("_old"), F.lit(True).alias("_a")), new.select(F.col(key), F.col("content_hash").alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def implied_folders(notes: DataFrame, markers: DataFrame | None = None, by: Sequence[str] = ("vault_id",)) -> DataFrame:
    """Folders that paths imply, with parent, but for those that have a marker."""
    found = notes.select(*by, F.explode(T.ancestors(T.folder(F.col("path")))).alias("folder")).distinct()
    if markers is not None:
        found = found.join(markers.select(*by, "folder"), [*by, "folder"], "left_anti")
    return found.withColumn("parent", T.parent(F.col("folder")))


def tree(notes: DataFrame, by: Sequence[str] = ("vault_id",)) -> DataFrame:
    """Every folder with the number of notes right in it; folders that only lie on the way count 0."""
    direct = notes.groupBy(*by, T.folder(F.col("path")).alias("folder")).agg(F.count("*").alias("notes"))
    both = direct.unionByName(implied_folders(notes, by=by).select(*by, "folder", F.lit(0).cast("bigint").alias("notes")))
    return both.groupBy(*by, "folder").agg(F.max("notes").alias("notes")).withColumn("parent", T.parent(F.col("folder")))


def in_subtree(folder: str, column: str = "folder") -> Column:
    return (F.col(column) == folder) | F.startswith(F.col(column), F.lit(folder + "/"))


def renamed_subtree(notes: DataFrame, old: str, new: str) -> DataFrame:
    """Notes below ``old`` with their paths below ``new``, and whether another note already has that path."""
    moved = notes.where(F.startswith("path", F.lit(old + "/"))).withColumn("new_path", F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1))))
    stay = notes.where(~F.startswith("path", F.lit(old + "/"))).select("vault_id", F.col("path").alias("new_path"), F.lit(True).alias("_taken"))
    return moved.join(stay, ["vault_id", "new_path"], "left").withColumn("conflict", F.coalesce("_taken", F.lit(False))).drop("_taken")


def retargeted(rows: DataFrame, moves: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with new_path by the longest matching ``old`` prefix of ``moves`` (old, new); null where none fits.

    The path's own ancestors are looked up, so this is an equality join, whatever the number of moves.
    """
    key = "_path_key"
    paths = rows.select(F.col(path).alias(key)).distinct()
    met = paths.select(key, F.explode(T.ancestors(F.col(key))).alias("old")).join(moves, "old")
    best = met.groupBy(key).agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("_m"))
    out = rows.join(best, rows[path] == best[key], "left")
    return out.select(*[rows[c] for c in rows.columns], F.concat(F.col("_m.new"), F.substr(rows[path], F.length("_m.old") + 1)).alias("new_path"))


def subtree_deletion(notes: DataFrame, folder: str, recursive: bool) -> DataFrame:
    """How many notes and folders a deletion takes, and whether it is allowed (a folder with notes only if recursive)."""
    below = notes.where(in_subtree(folder))
    return below.agg(F.count("*").alias("notes"), F.countDistinct("folder").alias("folders")).withColumn("allowed", F.lit(recursive) | (F.col("notes") == 0))


def batch_change(notes: DataFrame, ids: DataFrame, seq: int) -> DataFrame:
    """Tombstones for the requested ids, all with one seq; no rows at all if some id is unknown."""
    unknown = ids.join(notes, "id", "left_anti").agg(F.count("*").alias("_unknown"))
    hit = notes.join(ids.select("id").distinct(), "id", "left_semi").join(F.broadcast(unknown)).where("_unknown = 0").drop("_unknown")
    return hit.withColumn("seq", F.lit(seq).cast("bigint")).withColumn("deleted", F.lit(True))


def batch_move(notes: DataFrame, moves: DataFrame, seq: int) -> DataFrame:
    """The notes of ``moves`` (id, folder) in their new folders, all with one seq.

    No rows at all if some id is unknown or if two live notes would have one path.
    """
    unknown = moves.join(notes, "id", "left_anti").agg(F.count("*").alias("_unknown"))
    to = moves.groupBy("id").agg(F.max("folder").alias("_folder"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    after = notes.join(to, "id", "left").withColumn("path", F.when(F.col("_folder").isNull(), F.col("path")).otherwise(F.concat_ws("/", F.nullif("_folder", F.lit("")), name)))
    clash = after.groupBy("vault_id", "path").agg(F.count("*").alias("n"), F.count("_folder").alias("moved")).where("n > 1 and moved > 0").agg(F.count("*").alias("_clash"))
    hit = after.where("_folder is not null").join(F.broadcast(unknown)).join(F.broadcast(clash)).where("_unknown = 0 and _clash = 0")  # two single rows
    return hit.withColumn("folder", F.col("_folder")).withColumn("seq", F.lit(seq).cast("bigint")).select(*notes.columns)


def oldest_first(rows: DataFrame, stale: Column, by: str, id_: str, limit: int = 500) -> DataFrame:
    """The first ``limit`` stale rows, oldest first, ties by id: the next batch of a repair job."""
    return rows.where(stale).orderBy(by, id_).limit(limit)


def upsert(notes: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """Status of each change (key, base_hash, content_hash) against the present rows: created, unchanged, conflict or updated."""
    present = notes.select(key, F.col("content_hash").alias("_now"))
    joined = changes.join(present, key, "left")
    status = F.when(F.col("_now").isNull(), "created").when(F.col("_now") == F.col("content_hash"), "unchanged").when(F.col("base_hash").isNotNull() & (F.col("base_hash") != F.col("_now")), "conflict").otherwise("updated")
    return joined.select(*changes.columns, status.alias("status"))


def first_responses(requests: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first of the requests with one idempotency key."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return requests.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def without(stored: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """``stored`` without the rows of the keys: by note, by vault, by user."""
    return stored.join(keys.select(*by).distinct(), list(by), "left_anti").select(*stored.columns)


def replaced_rows(stored: DataFrame, new: DataFrame, key: str = "note_id") -> DataFrame:
    """``stored`` with all rows of the keys in ``new`` replaced by those of ``new``."""
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def patched(stored: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``stored`` with the columns that ``patch`` has a value for."""
    fresh = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return stored.join(fresh, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def patched_where(stored: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """``stored`` with the given columns overwritten, or added, in the rows that ``where`` holds for; others keep theirs or null."""
    hit = F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c) if c in stored.columns else F.lit(None)) for c, v in values.items()}
    return stored.select(*[new[c].alias(c) if c in new else F.col(c) for c in stored.columns], *[v.alias(c) for c, v in new.items() if c not in stored.columns])


def without_keys(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows without the named payload columns; unknown names don't matter."""
    return stored.drop(*keys)


def scroll(stored: DataFrame, where: Column, payload: Sequence[str], id_: str, after: object = None, limit: int = 256) -> DataFrame:
    """A page of a filtered scan in the order of ids, with the payload columns asked for only."""
    page = stored.where(where) if after is None else stored.where(where & (F.col(id_) > F.lit(after)))
    return page.select(id_, *payload).orderBy(id_).limit(limit)


def filtered_count(stored: DataFrame, where: Column, by: Sequence[str] = ()) -> DataFrame:
    """The exact number of rows that a filter leaves, whole or by columns."""
    return stored.where(where).groupBy(*by).agg(F.count("*").alias("n"))
