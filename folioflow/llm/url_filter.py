"""Filters pages by their URL: stated rules first, and a path-template tree for the rest.

The tree has a level for each of the first DEPTH path segments (the rest of a longer path is one more segment).  Level by
level, below each node (host and template so far):

* a segment is variable, and becomes ``*``, if its node has many different segments and it holds a small share of them;
* the other segments are merged into one branch ``~`` where their labelled share of bad pages doesn't differ from that of
  all their siblings by more than chance; a branch that differs stays under its own name.

The leaf templates get a smoothed purity, ``(bad + PRIOR_WEIGHT * base rate) / (labelled + PRIOR_WEIGHT)``, and templates
of purity PURITY or more are rejected.

URLs are counted by host and path before anything else, so a host with a third of all pages is as many rows as it has
paths.  Where statistics go back to what they were counted on, the count tells hot keys: rows of those stay where they are
and get their one row by a broadcast (``common.join_counted``), so nothing is copied and no key fills a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, join_counted, remove_dir

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEPTH = 4
MANY = 8  #: different segments from which a node can have variable ones
SHARE = 0.2  #: of its node's pages, below which a segment is variable
CHANCE = 2.0  #: standard errors within which branches count as similar
PRIOR_WEIGHT = 8.0
PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct of verdict and rule, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def segments(path_: Column) -> Column:
    """The path's non-empty segments, DEPTH of them and the rest as one."""
    parts = F.filter(F.split(path_, "/"), lambda s: s != "")
    rest = F.array_join(F.slice(parts, DEPTH + 1, F.greatest(F.size(parts) - DEPTH, F.lit(1))), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(rest))).otherwise(parts)


def templates(counted: DataFrame, run: Scratch) -> DataFrame:
    """``counted``, a stored table, has host, path, segs, pages, labelled and bad; the column template is added.

    Level by level; each level is written to the shared folder and the one before is removed.
    """
    total = counted.count()
    rows, begin = counted.withColumn("template", F.lit("")), len(run.paths)
    for level in range(DEPTH + 1):
        found = _level(rows, level, total, run)
        if found is None:  # no path is that deep
            break
        rows = run.write(found, "templates")
        for path in run.paths[begin:-1]:
            remove_dir(rows.sparkSession, path)
        begin = len(run.paths) - 1
    return rows


def _level(rows: DataFrame, level: int, total: int, run: Scratch) -> DataFrame | None:
    rows = rows.withColumn("seg", F.try_element_at("segs", F.lit(level + 1)))
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]
    children = run.write(rows.where("seg is not null").groupBy(*node, "seg").agg(*sums, F.count("*").alias("urls")), "children")
    segs = children.count()
    if not segs:
        return None
    below = children.groupBy(*node).agg(F.count("*").alias("kinds"), F.sum("pages").alias("all_pages"), F.count("*").alias("_rows"))
    variable = (F.col("kinds") >= MANY) & (F.col("pages") < SHARE * F.col("all_pages"))
    marked = run.write(join_counted(children, below, node, "_rows", total=segs, most=segs).withColumn("variable", variable), "marked")
    named = marked.where("not variable")
    pooled = named.groupBy(*node).agg(F.count("*").alias("named"), F.sum("labelled").alias("n"), F.sum("bad").alias("k"), F.count("*").alias("_rows"))
    p = F.try_divide("k", "n")
    gap = F.abs(F.try_divide("bad", "labelled") - p)
    similar = (F.col("labelled") == 0) | (F.col("n") == 0) | (gap <= CHANCE * F.sqrt(F.try_divide(p * (1 - p), F.col("labelled"))))
    merged = join_counted(named, pooled, node, "_rows", total=segs, most=segs).select(*node, "seg", "urls", F.when((F.col("named") > 1) & similar, "~").otherwise(F.col("seg")).alias("name"))
    names = run.write(marked.where("variable").select(*node, "seg", "urls", F.lit("*").alias("name")).unionByName(merged), "names")
    out = join_counted(rows, names, [*node, "seg"], "urls", "left", total=total, most=total)
    return out.withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))).drop("seg", "name")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    ``labels`` has page_id and bad (0 or 1, others and nulls don't count; of several labels of a page, bad wins).  The
    rule decides where one fits; otherwise the template.  A null url, or one without ``://``, has an empty host and path
    and is judged by the template of those.  Null page_ids and repeated rows each keep their row; other columns are not
    read.
    """
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = labels.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("bad in (0, 1)").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = urls.join(known, "page_id", "left").groupBy("host", "path").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    run = Scratch(pages.sparkSession, "url-filter")
    counted = run.write(counted.withColumn("segs", segments(F.col("path"))), "urls")
    bad, labelled, total, most, rows = counted.agg(F.sum("bad"), F.sum("labelled"), F.sum("pages"), F.max("pages"), F.count("*")).first()
    base = bad / labelled if labelled else 0.0
    leaves = templates(counted, run)
    score = leaves.groupBy("host", "template").agg(((F.sum("bad") + PRIOR_WEIGHT * base) / (F.sum("labelled") + PRIOR_WEIGHT)).alias("purity"), F.count("*").alias("urls"))
    named = run.finish(join_counted(leaves.select("host", "path", "template", "pages"), score, ["host", "template"], "urls", total=rows, most=rows))
    all_ = join_counted(urls, named, ["host", "path"], "pages", total=total, most=most)
    found = all_.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
