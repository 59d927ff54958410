"""Frontmatter without loss: a note as spans that tile it byte for byte, and back.

A key at the margin owns the lines from its own to the next key's.  What comes before the first key (comments, blank lines)
is the head.  So ``project(tiled(content))`` is ``content`` for every text: comments, blank lines, quotes, repeated keys, CRLF
and text that is no YAML at all stay as they are.  Everything is Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTE = r"(?s)\A(---[ \t]*\r?\n)(.*?)((?<=\n)---[ \t]*(?:\r?\n|\z))(.*)\z"
KEY = r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s#:'"\-\[\]{}][^:\n]*?))[ \t]*:(?=[ \t\r\n]|\z)"""


def tiled(content: Column) -> Column:
    """opening, head, keys, raws, closing and body of a note; a null gives null.

    ``raws`` are the keys' spans in order, as they stand.  A text without frontmatter is all body, the rest empty.
    """
    has = content.rlike(NOTE)
    part = lambda i: F.when(has, F.regexp_extract(content, NOTE, i)).otherwise(F.lit("") if i < 4 else content)
    spans = F.split(part(2), rf"(?<=\n)(?={KEY})")
    starts = spans[0].rlike(rf"\A{KEY}")
    raws = F.when(starts, spans).otherwise(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))))
    name = lambda s: F.coalesce(*[F.nullif(F.regexp_extract(s, rf"\A{KEY}", i), F.lit("")) for i in (1, 2, 3)])
    fields = [part(1).alias("opening"), F.when(starts, F.lit("")).otherwise(spans[0]).alias("head"), F.transform(raws, name).alias("keys"), raws.alias("raws"), part(3).alias("closing"), part(4).alias("body")]
    return F.when(content.isNotNull(), F.struct(*fields))


def project(note: Column) -> Column:
    """The text of a tiled note."""
    return F.concat(note["opening"], note["head"], F.array_join(note["raws"], ""), note["closing"], note["body"])


def _rebuilt(note: Column, keys: Column, raws: Column) -> Column:
    """A note with other keys; one without frontmatter gets fences."""
    bare = (note["opening"] == "") & (F.size(raws) > 0)
    fence = lambda name: F.when(bare, "---\n").otherwise(note[name]).alias(name)
    return F.struct(fence("opening"), note["head"].alias("head"), keys.alias("keys"), raws.alias("raws"), fence("closing"), note["body"].alias("body"))


def with_key(note: Column, key: str, line: Column) -> Column:
    """The note with ``key``'s spans replaced by ``line`` (its YAML, with a line end), at their first place or at the end."""
    at = F.array_position(note["keys"], key)
    both = F.filter(F.arrays_zip(note["keys"].alias("k"), note["raws"].alias("r")), lambda x, i: (x["k"] != key) | (i + 1 == at))
    keys = F.transform(both, lambda x: x["k"])
    raws = F.transform(both, lambda x: F.when(x["k"] == key, line).otherwise(x["r"]))
    new = at == 0
    return _rebuilt(note, F.when(new, F.array_append(keys, F.lit(key))).otherwise(keys), F.when(new, F.array_append(raws, line)).otherwise(raws))


def without_key(note: Column, key: str) -> Column:
    """The note without the spans of ``key``."""
    mine = F.arrays_zip(note["keys"].alias("k"), note["raws"].alias("r"))
    left = F.filter(mine, lambda x: x["k"] != key)
    return _rebuilt(note, F.transform(left, lambda x: x["k"]), F.transform(left, lambda x: x["r"]))
