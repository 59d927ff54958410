"""Scalar functions on notes as Spark columns: titles, folders, tags, paths, sizes, classes.

All take and return columns and stay inside Spark's generated code, but for the few that say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One recogniser for a frontmatter block serves all functions; it takes CRLF line ends and a block that ends the text.
FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(.*?)(?:(?<=\n)|\r?\n)---[ \t]*(?:\r?\n|\z)"
CODE_SPANS = (r"(?s)```.*?```", r"(?s)~~~.*?~~~", r"`[^`\n]*`")
INLINE_TAG = r"(?U)(?:^|\s)#(\w[\w/-]*)"
ILLEGAL_IN_PATHS = r'[\\:*?<>"|]'



def frontmatter(content: Column) -> Column:
    """The block between the fences; null where there is none."""
    return F.when(content.rlike(FRONTMATTER), F.regexp_extract(content, FRONTMATTER, 1))


def body(content: Column) -> Column:
    """The text after the frontmatter block."""
    return F.regexp_replace(content, FRONTMATTER, "")


def _or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def file_root(path: Column) -> Column:
    """The last segment without its extension; a leading dot is no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def title(content: Column, path: Column) -> Column:
    """Frontmatter title, else the first level-1 heading after it, else the file's name."""
    return F.coalesce(_or_null(F.regexp_extract(F.coalesce(frontmatter(content), F.lit("")), r"(?m)^title:[ \t]*(.+)$", 1)), _or_null(F.regexp_extract(body(content), r"(?m)^#\s+(.+)$", 1)), file_root(path))


def folder(path: Column) -> Column:
    """All but the last segment; empty at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def unquoted(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.regexp_replace(trimmed, r"""\A(?:"(.*)"|'(.*)')\z""", "$1$2")


def frontmatter_tags(content: Column) -> Column:
    """A block list below a bare ``tags:``, else ``[a, b]`` or ``a, b`` on its line; quotes and empty ones dropped."""
    block = F.coalesce(frontmatter(content), F.lit(""))
    listed = F.regexp_extract(block, r"(?m)^tags:[ \t]*\r?\n((?:\s*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    items = F.transform(F.filter(F.split(listed, r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: unquoted(F.regexp_replace(x, r"^\s*-\s+", "")))
    inline = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(block, r"(?m)^tags:[ \t]*(\S.*)$", 1)), r"^\[", ""), r"\]+\s*$", "")
    either = F.when(listed != "", items).otherwise(F.transform(F.split(inline, ","), unquoted))
    return F.filter(either, lambda t: t != "")


def inline_tags(content: Column) -> Column:
    """``#tag`` and ``#area/sub`` outside frontmatter and code; purely numeric ones are no tags."""
    text = body(content)
    for span in CODE_SPANS:
        text = F.regexp_replace(text, span, " ")
    found = F.transform(F.regexp_extract_all(text, F.lit(INLINE_TAG), 1), lambda t: F.regexp_replace(t, r"[/-]+$", ""))
    return F.filter(found, lambda t: (t != "") & ~t.rlike(r"^[0-9/_-]+$"))


def tags(content: Column) -> Column:
    """Frontmatter tags, then inline ones, each once."""
    return F.array_distinct(F.concat(frontmatter_tags(content), inline_tags(content)))


def basename_key(target: Column) -> Column:
    """Last segment, lower case, without ``.md`` or ``.canvas``: what links are matched by."""
    return F.regexp_replace(F.lower(F.element_at(F.split(target, "/"), -1)), r"\.(md|canvas)$", "")


def derived_title(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def ancestors(path: Column) -> Column:
    """``a/b/c`` gives ``[a, a/b, a/b/c]``; an empty path gives none."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def parent(path: Column) -> Column:
    """The folder above; null for a top-level folder and for the root."""
    return F.nullif(folder(path), F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def appended(content: Column, text: Column) -> Column:
    return F.concat(F.regexp_replace(content, r"\n+\z", ""), F.lit("\n"), text)


def replaced_occurrence(content: Column, old: str, new: str, occurrence: int) -> Column:
    """``content`` with the occurrence-th (from 0) ``old`` replaced, or all of them for -1."""
    if occurrence < 0:
        return F.replace(content, F.lit(old), F.lit(new))
    parts = F.split(content, f"\\Q{old}\\E", -1)
    head, tail = F.array_join(F.slice(parts, 1, occurrence + 1), old), F.array_join(F.slice(parts, occurrence + 2, F.greatest(F.size(parts) - occurrence - 1, F.lit(1))), old)
    return F.when(F.size(parts) > occurrence + 1, F.concat(head, F.lit(new), tail)).otherwise(content)


#: what Python's ``str.strip`` and ``\s`` take for white space, but for the newline
_BLANK = r"[\t\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def section_replaced(content: Column, heading: str, text: str) -> Column:
    """``content`` with the lines below a heading replaced, up to the next heading of its level or above; null if absent."""
    level = min(len(heading) - len(heading.lstrip("#")), 6)
    quoted = "\\Q" + heading.strip().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    until = rf"\n#{{1,{level}}}{_BLANK}|\z" if level else r"\z"
    found = rf"(?s)\A((?:|.*?\n){_BLANK}*{quoted}{_BLANK}*(?![^\n]))"
    new = text.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(content.rlike(found), F.regexp_replace(content, rf"{found}.*?(?={until})", f"$1\n{new}"))


def rendered(content: Column, note_title: Column, note_tags: Column) -> Column:
    """The note with a title line and a tag line in front, where its body doesn't have them."""
    head = F.when(~content.rlike(r"(?m)^#\s+\S"), F.concat(F.lit("# "), note_title, F.lit("\n\n"))).otherwise("")
    line = F.when((F.size(note_tags) > 0) & ~content.rlike(r"(?m)^tags:"), F.concat(F.lit("Tags: "), F.array_join(note_tags, ", "), F.lit("\n\n"))).otherwise("")
    return F.concat(head, line, content)


def origin_rules(app: str, desktop: tuple[str, ...] = ()) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Classes of user agents in the order in which they are tried, for an application's own clients and the rest."""
    own = (("plugin", (f"{app}-obsidian",)), ("mobile", (f"{app}-mobile",)), ("cli", (f"{app}-cli",)), ("web_spa", (f"{app}-web",)))
    return (*own, ("mcp_desktop", desktop), ("mcp_other", ("mcp/", "modelcontext")), ("browser", ("mozilla", "chrome", "safari", "firefox")))


def classified_origin(agent: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], other: str = "other") -> Column:
    """The first class of which a substring is in the lower-cased user agent; null or empty is ``unknown``."""
    low, out = F.lower(agent), F.when(agent.isNull() | (F.trim(agent) == ""), "unknown")
    for name, parts in rules:
        for part in parts:
            out = out.when(F.contains(low, F.lit(part)), name)
    return out.otherwise(other)


def first_timestamp(values: Column, *keys: str) -> Column:
    """The first of the map's keys that is an ISO date or date and time, to the second; a bare date is midnight UTC."""
    tries = [F.date_trunc("second", F.try_to_timestamp(F.try_element_at(values, F.lit(k)))) for k in keys]
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


def okf_fields(values: Column) -> list[Column]:
    """type, description and resource of a note's frontmatter (JSON values), and its two timestamps.

    The three are the map's strings, blank or of another kind null; fm_timestamp is the first valid of timestamp, modified
    and updated, fm_created of created and date.
    """
    text = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(values, F.lit(k)), F.lit("}")), "$.v")
    string = lambda k: F.when(F.startswith(F.try_element_at(values, F.lit(k)), F.lit('"')), _or_null(text(k))).alias(k)
    plain = F.transform_values(values, lambda k, v: F.regexp_replace(v, '^"|"$', ""))
    return [*[string(k) for k in ("type", "description", "resource")], first_timestamp(plain, "timestamp", "modified", "updated").alias("fm_timestamp"), first_timestamp(plain, "created", "date").alias("fm_created")]


def sanitised_path(path: Column) -> Column:
    """A path safe on every file system, but for the 255-byte limit of a segment, which ``sanitise`` (Python) adds."""
    clean = F.regexp_replace(F.regexp_replace(path, "\u0000", ""), ILLEGAL_IN_PATHS, "")
    clean = F.regexp_replace(clean, "^/+", "")
    parts = F.transform(F.split(clean, "/"), lambda s: F.regexp_replace(F.replace(F.trim(s), F.lit(".."), F.lit("")), " {2,}", " "))
    return F.array_join(F.filter(parts, lambda s: ~s.isin("", ".", "..", ". .")), "/")
