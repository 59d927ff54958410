"""Functions on notes that Spark has no built-in for; each is a small helper, used through Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
import urllib.parse
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import FRONTMATTER, section_replaced  # noqa: F401  (the column form of replaced_section)

_FRONTMATTER = re.compile(FRONTMATTER.replace(r"\z", r"\Z"))
_ILLEGAL = re.compile(r'[\\:*?<>"|]')


def _series(function: Callable, returns: str) -> Callable[..., Column]:
    """A pandas UDF that applies ``function`` to the values of its columns; null in the first gives null."""

    def batch(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else function(*x) for x in zip(first, *rest, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return batch(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, returns)(*columns)


def scrub_utf8(raw: bytes) -> str:
    """Text of bytes in which each invalid byte is one replacement character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out += [raw[at : at + error.start].decode(), "�"]
            at += error.start + 1
    return "".join(out)


def percent_decoded(text: str) -> str:
    """Percent escapes decoded, malformed ones and ``+`` left alone, invalid bytes scrubbed."""
    return scrub_utf8(urllib.parse.unquote_to_bytes(text))


def sanitise(path: str) -> str:
    out = []
    for part in _ILLEGAL.sub("", percent_decoded(path.replace("\0", ""))).lstrip("/").split("/"):
        part = re.sub(" {2,}", " ", part.strip().replace("..", ""))
        part = part.encode()[:255].decode("utf-8", "ignore")
        if part not in ("", ".", "..", ". ."):
            out.append(part)
    return "/".join(out)


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def normalised_type(text: str) -> str:
    return nfkc(text).lower()


def keyed_hash(text: str, key: str) -> str:
    return hmac.new(key.encode(), text.encode(), hashlib.sha256).hexdigest()


def minimal_edit(old: str, new: str) -> tuple[int, int, str]:
    """Offset and length of what goes, in UTF-16 units, and what comes instead; common ends stay."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    units = lambda s: len(s.encode("utf-16-le")) // 2
    return units(old[:head]), units(old[head : len(old) - tail]), new[head : len(new) - tail]


def replaced_section(content: str, heading: str, text: str) -> str | None:
    """``content`` with the lines below a heading replaced, up to the next heading of its level or above; null if absent."""
    lines = content.split("\n")
    level = len(heading) - len(heading.lstrip("#"))
    for i, line in enumerate(lines):
        if line.strip() == heading.strip():
            stop = next((j for j in range(i + 1, len(lines)) if (m := re.match(r"(#{1,6})\s", lines[j])) and len(m[1]) <= level), len(lines))
            return "\n".join([*lines[: i + 1], text, *lines[stop:]])
    return None


# --- frontmatter ------------------------------------------------------------------------------------------------------


def raw_spans(block: str) -> dict[str, str] | None:
    """The lines that each key at the margin owns, with comments and blank lines before the first key under ``""``.

    Null if a key comes twice or something else stands before the first one.
    """
    out: dict[str, list[str]] = {}
    key = None
    for line in block.split("\n"):
        m = re.match(r"""(?:"([^"]+)"|'([^']+)'|([^\s#:'"-][^:]*?))\s*:(?:\s|$)""", line)
        if m:
            key = m[1] or m[2] or m[3]
            if key in out:
                return None
            out[key] = []
        elif key is None:
            if line.strip() and not line.startswith("#"):
                return None
            out.setdefault("", [])
        out[key or ""].append(line)
    return {k: "\n".join(v) for k, v in out.items()}


def parsed_frontmatter(content: str) -> tuple[list[str], dict[str, str], str | None]:
    """Keys in order, their values as JSON, and why the block couldn't be parsed (never its contents)."""
    import yaml

    found = _FRONTMATTER.search(content)
    if not found:
        return [], {}, None
    spans = raw_spans(found[1].replace("\r\n", "\n"))
    try:
        whole = yaml.safe_load(found[1])
    except (yaml.YAMLError, ValueError):
        return [], {}, "frontmatter_invalid_yaml"
    if whole is None:
        return [], {}, None
    if not isinstance(whole, dict):
        return [], {}, "frontmatter_invalid_yaml"
    reason = None if spans is not None and all(isinstance(k, str) for k in whole) else "frontmatter_unparseable_key"
    values = {str(k): json.dumps(v, default=str, ensure_ascii=False) for k, v in whole.items()}
    return list(values), values, reason


def emitted_frontmatter(keys: list[str], values: dict[str, str], text: str) -> str:
    """A note from ordered keys, JSON values and a body; parsing it gives the same keys and values."""
    import yaml

    if not len(keys):
        return text
    block = "".join(yaml.safe_dump({k: json.loads(values[k])}, allow_unicode=True, sort_keys=False, default_flow_style=False, width=2**30) for k in keys)
    return f"---\n{block}---\n{text}"


scrubbed = _series(scrub_utf8, "string")
decoded = _series(percent_decoded, "string")
clean_path = _series(sanitise, "string")
nfkc_text = _series(nfkc, "string")
type_key = _series(normalised_type, "string")
keyed_content_hash = _series(keyed_hash, "string")


def _edits(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([minimal_edit(a or "", b or "") for a, b in zip(old, new, strict=True)], columns=["offset", "deleted", "inserted"])


def edit(old: Column, new: Column) -> Column:
    """offset, deleted and inserted of the one edit that turns ``old`` into ``new``."""
    return F.pandas_udf(_edits, "struct<offset:int,deleted:int,inserted:string>")(old, new)


def _fields(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed_frontmatter(c or "") for c in content], columns=["keys", "values", "reason"])


def frontmatter_fields(content: Column | str) -> Column:
    """keys, values and reason of a note's frontmatter."""
    return F.pandas_udf(_fields, "struct<keys:array<string>,values:map<string,string>,reason:string>")(content)
