"""The link graph: extraction with byte offsets, resolution, backlinks, danglers, rewriting after renames."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.python_text import _FRONTMATTER, percent_decoded

BACKLINKS = 200
_WIKI = re.compile(r"(!?)\[\[([^\]\[]+?)\]\]")
_MARKDOWN = re.compile(r"(!?)\[([^\]\[]*)\]\(((?:[^()]|\([^()]*\))*)\)")
_EXTERNAL = re.compile(r"(?:[a-z][a-z0-9+.\-]*:|//)", re.I)
_CODE = (re.compile(r"```.*?```", re.S), re.compile(r"~~~.*?~~~", re.S), re.compile(r"`[^`\n]*`"))

LINK = "struct<position:int,target:string,target_raw:string,target_start:int,target_len:int,alias:string,anchor:string,link_type:string,form:string>"
_FIELDS = {name: pa.int32() if kind == "int" else pa.string() for name, kind in (field.split(":") for field in LINK[7:-1].split(","))}


def extracted(content: str) -> list[tuple]:
    """Links outside frontmatter and code in the order of their place; places and lengths are bytes."""
    if "[" not in content:
        return []
    hidden = [m.span() for p in _CODE for m in p.finditer(content)]
    if front := _FRONTMATTER.match(content):
        hidden.append(front.span())
    found = []
    for m in _WIKI.finditer(content):
        inner, _, alias = m[2].partition("|")
        raw, _, anchor = inner.partition("#")
        if target := raw.strip():
            at = m.start(2) + len(raw) - len(raw.lstrip())
            found.append((m.start(), target, target, at, alias.strip() or None, anchor.strip() or None, m[1], "wiki"))
    for m in _MARKDOWN.finditer(content):
        dest = m[3].strip()
        at = m.start(3) + len(m[3]) - len(m[3].lstrip())
        if dest.startswith("<") and ">" in dest:
            dest, at = dest[1 : dest.index(">")], at + 1
        else:
            dest = re.split(r"[ \t\n\r]", dest, maxsplit=1)[0]
        raw, _, anchor = dest.partition("#")
        if raw and not _EXTERNAL.match(raw):
            found.append((m.start(), percent_decoded(raw), raw, at, m[2].strip() or None, percent_decoded(anchor).strip() or None, m[1], "markdown"))
    found = sorted({f[0]: f for f in reversed(found) if not any(a <= f[0] < b for a, b in hidden)}.values())
    out, done, size = [], 0, 0
    for place, target, raw, at, alias, anchor, bang, form in found:
        size += len(content[done:place].encode())
        done = place
        out.append((size, target, raw, size + len(content[place:at].encode()), len(raw.encode()), alias, anchor, "embed" if bang else "wikilink", form))
    return out


def _extract(contents: pa.Array) -> pa.Array:
    """``extracted`` of a batch, a text at a time: beside the batch only one text and the links found are held."""
    found, ends = [], [0]
    for content in contents:
        found += extracted(content.as_py() or "")
        ends.append(len(found))
    columns = zip(*found) if found else [()] * len(_FIELDS)
    fields = [pa.array(column, kind) for column, kind in zip(columns, _FIELDS.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, list(_FIELDS)))


def extract_links(notes: DataFrame, note_id: str = "note_id", content: str = "content") -> DataFrame:
    """A row for each link: note_id, its fields and the basename_key of its target."""
    rows = notes.select(F.col(note_id).alias("source_note_id"), *([F.col("vault_id")] if "vault_id" in notes.columns else []), F.explode(F.arrow_udf(_extract, f"array<{LINK}>")(content)).alias("_l"))
    return rows.select(*[c for c in rows.columns if c != "_l"], "_l.*").withColumn("basename_key", T.basename_key(F.col("target")))


def extension(target: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(target, "/"), -1), r".(\.[^.]*)$", 1))


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``edges`` with target_note_id, target_attachment_id, target_path and dangling.

    ``files`` has vault_id, id, path and kind (note or attachment) of live files.  A target without extension, or with
    .md or .canvas, prefers notes, any other prefers attachments; the other kind is the fallback.  A target with a slash
    must be the whole path, as given or with .md or .canvas, whatever the case.  The shortest path wins, then the first
    in order.  The files' names are ranked once, so an edge meets one row, however many files share a name.
    """
    low, bare = F.lower("path"), T.basename_key(F.col("path"))
    stem = F.regexp_replace(low, r"\.(md|canvas)$", "")
    whole = F.filter(F.array(low, F.when(T.basename_key(stem) == bare, stem)), lambda k: F.contains(k, F.lit("/")))
    ranked = lambda first: F.min(F.struct(F.when(F.col("kind") == first, 0).otherwise(1).alias("p"), F.length("path").alias("n"), "path", "id", "kind"))
    named = files.select("vault_id", F.explode(F.array_distinct(F.array_append(whole, bare))).alias("_key"), "path", "id", "kind")
    names = named.groupBy("vault_id", "_key").agg(ranked("note").alias("_notes"), ranked("attachment").alias("_others"))
    notes_first = extension(F.col("target")).isin("", ".md", ".canvas")
    keyed = edges.withColumn("_key", F.when(F.contains("target", F.lit("/")), F.lower("target")).otherwise(F.col("basename_key")))
    out = keyed.join(names, ["vault_id", "_key"], "left").withColumn("_b", F.when(notes_first, F.col("_notes")).otherwise(F.col("_others")))
    return out.select(*edges.columns, F.when(F.col("_b.kind") == "note", F.col("_b.id")).alias("target_note_id"), F.when(F.col("_b.kind") != "note", F.col("_b.id")).alias("target_attachment_id"), F.col("_b.path").alias("target_path"), F.col("_b").isNull().alias("dangling"))


def outgoing(resolved: DataFrame) -> DataFrame:
    """The edges of each note in the order of the parser: position, target, path of the target, whether it dangles."""
    return resolved.select("source_note_id", "position", "target", "alias", "link_type", "target_note_id", "target_path", "dangling").orderBy("source_note_id", "position")


def backlinks(resolved: DataFrame, notes: DataFrame, limit: int = BACKLINKS) -> DataFrame:
    """For each target note the first ``limit`` edges by position and source, with the source's path and title."""
    order = Window.partitionBy("target_note_id").orderBy("position", "source_note_id")
    first = resolved.where("target_note_id is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")
    return first.join(notes.select(F.col("note_id").alias("source_note_id"), F.col("path").alias("source_path"), F.col("title").alias("source_title")), "source_note_id")


def danglers(resolved: DataFrame) -> DataFrame:
    """Basenames that some edge misses, with the number of edges and of source notes."""
    return resolved.where("dangling").groupBy("vault_id", "basename_key").agg(F.count("*").alias("edges"), F.countDistinct("source_note_id").alias("sources"))


def basename_collisions(files: DataFrame) -> DataFrame:
    return files.groupBy("vault_id", T.basename_key(F.col("path")).alias("basename_key")).agg(F.count("*").alias("files"))


def affected_sources(resolved: DataFrame, renamed: DataFrame) -> DataFrame:
    """Notes with a link to a renamed note."""
    return resolved.join(renamed.select(F.col("note_id").alias("target_note_id")).distinct(), "target_note_id", "left_semi").select("source_note_id").distinct()


def without_deleted(resolved: DataFrame, deleted: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Edges after notes, and ``attachments`` (attachment_id), were deleted: notes' own links go, links to them dangle."""
    if attachments is not None:
        lost = attachments.select(F.col("attachment_id").alias("_lost")).distinct()
        marked = resolved.join(lost, resolved["target_attachment_id"] == lost["_lost"], "left")
        hit = F.col("_lost").isNotNull()
        resolved = marked.select(*[F.when(~hit, F.col(c)).alias(c) if c in ("target_attachment_id", "target_path") else (F.col("dangling") | hit).alias(c) if c == "dangling" else F.col(c) for c in resolved.columns])
    gone = deleted.select(F.col("note_id").alias("_gone")).distinct()
    left = resolved.join(gone, resolved["source_note_id"] == gone["_gone"], "left_anti")
    marked = left.join(gone, left["target_note_id"] == gone["_gone"], "left")
    hit = F.col("_gone").isNotNull()
    return marked.select(*[F.when(~hit, F.col(c)).alias(c) if c in ("target_note_id", "target_path") else (F.col("dangling") | hit).alias(c) if c == "dangling" else F.col(c) for c in resolved.columns])


def rebound(edges: DataFrame, files: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with the given basenames (vault_id, basename_key), resolved anew: after a file came, went or moved."""
    return resolve(edges.join(keys.select("vault_id", "basename_key").distinct(), ["vault_id", "basename_key"], "left_semi"), files)


def pre_rename_winners(edges: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges that resolved to a renamed note while it had its old path (note_id, old_path): those that a rename may rewrite."""
    old = renames.select(F.col("note_id").alias("id"), "old_path")
    before = files.join(old, "id", "left").select("vault_id", "id", F.coalesce("old_path", "path").alias("path"), "kind")
    return resolve(edges, before).join(old.select(F.col("id").alias("target_note_id")), "target_note_id", "left_semi")


def repairs(resolved: DataFrame, renames: DataFrame) -> DataFrame:
    """Basenames that dangle although a recent rename (vault_id, old_path) left them."""
    old = renames.select("vault_id", T.basename_key(F.col("old_path")).alias("basename_key")).distinct()
    return danglers(resolved).select("vault_id", "basename_key").join(old, ["vault_id", "basename_key"], "left_semi")


def rewritten(content: str, edits: list[tuple[int, int, str]]) -> str:
    """``content`` with byte ranges replaced, from right to left."""
    raw = content.encode()
    for start, length, new in sorted(edits, reverse=True):
        raw = raw[:start] + new.encode() + raw[start + length :]
    return raw.decode("utf-8", "replace")


def new_target(raw: Column, form: Column, new_path: Column, collides: Column) -> Column:
    """How a link to a moved note is spelled: bare stays bare unless the new name isn't unique, an extension stays or
    stays away, and markdown targets are percent-encoded."""
    bare = ~F.contains(raw, F.lit("/")) & ~collides
    path = F.when(bare, F.element_at(F.split(new_path, "/"), -1)).otherwise(new_path)
    spelled = F.when(F.lower(raw).rlike(r"\.(md|canvas)$"), path).otherwise(F.regexp_replace(path, r"\.(md|canvas)$", ""))
    return F.when(form == "markdown", F.replace(F.replace(F.replace(spelled, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("#"), F.lit("%23"))).otherwise(spelled)


def rewrite_notes(notes: DataFrame, resolved: DataFrame, renames: DataFrame, files: DataFrame) -> DataFrame:
    """note_id and the new content of every note with a link to a renamed note.

    ``renames`` has note_id and new_path; ``files`` are the live files after the rename.  Running it again changes nothing.
    """
    counts = basename_collisions(files)
    moved = renames.select(F.col("note_id").alias("target_note_id"), "new_path", T.basename_key(F.col("new_path")).alias("_k"))
    edges = resolved.join(moved, "target_note_id").join(counts.select("vault_id", F.col("basename_key").alias("_k"), "files"), ["vault_id", "_k"], "left")
    spelled = new_target(F.col("target_raw"), F.col("form"), F.col("new_path"), F.coalesce("files", F.lit(0)) > 1)
    edits = edges.groupBy("source_note_id").agg(F.collect_list(F.struct(F.col("target_start"), F.col("target_len"), spelled.alias("new"))).alias("edits"))

    @F.pandas_udf("string")
    def splice(contents: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([rewritten(c, [(e["target_start"], e["target_len"], e["new"]) for e in es]) for c, es in zip(contents, lists, strict=True)])

    return notes.join(edits.withColumnRenamed("source_note_id", "note_id"), "note_id").select("note_id", splice("content", "edits").alias("content"))
