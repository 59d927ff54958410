"""Heading-aware chunks of notes.

A note gives its sections in order, each cut into pieces of at most ``limit`` bytes at spaces, and then its frontmatter
block as one more chunk.  A few notes are long and most are short, so the cutting is a pandas UDF over batches that
returns an array, which Spark explodes: the number of rows grows in Spark and not in Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.python_text import _FRONTMATTER

LIMIT = 2048
_HEADING = re.compile(r"(#{1,6})\s+(.+)")
_FENCE = re.compile(r"\s*(```|~~~)")

CHUNKS = "array<struct<heading_path:string,char_start:int,char_end:int,text:string>>"


def sections(body: str, respect_fences: bool = False) -> list[tuple[list[tuple[int, str]], int, int, str]]:
    """(headings above, first byte, last byte, text) of each section with text; a heading begins its section."""
    out, stack, lines, start, at, fenced = [], [], [], 0, 0, None

    def close(end: int) -> None:
        text = "\n".join(lines).strip()
        if text:
            out.append((stack, start, end, text))

    for line in body.split("\n"):
        fence = _FENCE.match(line) if respect_fences else None
        if fence:
            fenced = None if fenced == fence[1] else fenced or fence[1]
        found = None if fenced else _HEADING.fullmatch(line)
        if found:
            close(at - 1)
            stack = [h for h in stack if h[0] < len(found[1])] + [(len(found[1]), found[2])]
            lines, start = [], at
        lines.append(line)
        at += len(line.encode()) + 1
    close(len(body.encode()))
    return out


def pieces(text: str, limit: int = LIMIT) -> list[str]:
    """Runs of words of at most ``limit`` bytes; a longer word stays whole."""
    if len(text.encode()) <= limit:
        return [text]
    out, held, size = [], [], 0
    for word in text.split(" "):
        more = len(word.encode()) + (1 if held else 0)
        if held and size + more > limit and any(held):
            out.append(" ".join(held))
            held, size, more = [], 0, len(word.encode())
        held.append(word)
        size += more
    return out + [" ".join(held)] if any(held) else out


def chunked(content: str | None, title: str, limit: int = LIMIT, respect_fences: bool = False) -> list[tuple[str, int, int, str]]:
    if not content:
        return []
    found = _FRONTMATTER.search(content)
    body, out = content[found.end() :] if found else content, []
    for stack, start, end, text in sections(body, respect_fences):
        names = [h for _, h in (stack[1:] if stack and stack[0][0] == 1 else stack)]
        out += [(" > ".join([title, *names]), start, end, p) for p in pieces(text, limit)]
    if found and found[1]:
        out.append(("frontmatter", 0, 0, found[1]))
    return out


def chunk_notes(notes: DataFrame, limit: int = LIMIT, respect_fences: bool = False, content: str = "content", path: str = "path") -> DataFrame:
    """One row for each chunk: the columns of ``notes`` without the content, then position, heading_path, char_start,
    char_end (bytes in the body; all pieces of a section carry the section's), text and context_text (folder and
    headings, a blank line, the text).  Empty notes give no rows."""

    @F.pandas_udf(CHUNKS)
    def run(contents: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([chunked(c, t or "", limit, respect_fences) for c, t in zip(contents, titles, strict=True)])

    title = T.title(F.col(content), F.col(path))
    rest = [c for c in notes.columns if c != content]
    rows = notes.select(*rest, F.posexplode(run(F.col(content), F.coalesce(title, F.lit("")))).alias("position", "_c"), title.alias("_title"))
    above = F.when(F.col("_c.heading_path") == "frontmatter", F.concat_ws(" > ", "_title", F.lit("frontmatter"))).otherwise(F.col("_c.heading_path"))
    prefix = F.concat_ws(" > ", F.nullif(T.folder(F.col(path)), F.lit("")), above)
    return rows.select(*rest, "position", "_c.heading_path", "_c.char_start", "_c.char_end", "_c.text", F.concat(prefix, F.lit("\n\n"), F.col("_c.text")).alias("context_text"))


def language_sample(chunks: DataFrame, note_id: str = "note_id", n: int = 3) -> DataFrame:
    """note_id and the text of its first ``n`` chunks but for frontmatter, for language detection."""
    ranked = chunks.where("heading_path <> 'frontmatter'").withColumn("_r", F.row_number().over(Window.partitionBy(note_id).orderBy("position"))).where(F.col("_r") <= n)
    return ranked.groupBy(note_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("sample"))

