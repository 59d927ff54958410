import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions import python_text as P
from folioflow.functions import text as T
from folioflow.functions.stemming import stem_english
from folioflow.operators import chunking, keyword, links


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("content,path,want", [("---\ntitle:  My Custom Title \n---\n# H1\n", "a.md", "My Custom Title"), ("text\n# Real  \n## Two", "a.md", "Real"), ("plain", "d/Some.File.md", "Some.File"), ("---\r\ntitle: CR\r\n---\r\nx", "a.md", "CR"), ("", ".hidden", ".hidden")])
def test_title(spark, content, path, want):
    assert one(spark, T.title(F.col("c"), F.col("p")), c=content, p=path) == want


@pytest.mark.parametrize("content,want", [("---\ntags: [health, \"fit ness\"]\n---\n#x", ["health", "fit ness", "x"]), ("---\ntags: a, b\n---\n", ["a", "b"]), ("---\ntags:\n  - one\n  - 'two'\nk: v\n---\n", ["one", "two"]), ("---\r\ntags:\r\n- one\r\n- two\r\n---\r\nbody #area/sub/ #42 #1/2 w#no `#code`", ["one", "two", "area/sub"]), ("```\n#no\n```\n~~~\n#no2\n~~~\n#über #a", ["über", "a"]), ("---\ntags: []\n---\nx", []), ("# heading #tag https://h/#frag", ["tag"]), ("#628–x", [])])
def test_tags(spark, content, want):
    assert one(spark, T.tags(F.col("c")), c=content) == want


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/C.md",), ("X.canvas",), ("",), ("a/b/",)], "p string")
    got = rows.select(T.folder(F.col("p")), T.basename_key(F.col("p")), T.ancestors(F.col("p")), T.parent(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("a/b", "c", ["a", "a/b", "a/b/C.md"], "a/b"), ("", "x", ["X.canvas"], None), ("", "", [], None), ("a/b", "", ["a", "a/b"], "a/b")]
    assert one(spark, T.sanitised_path(F.col("p")), p="/a//b:? c/../.. /.. /d   e.md") == "a/b c/d e.md"


@pytest.mark.parametrize("dirty,want", [("a\0b", "ab"), ("a%2F..%2Fb", "a/b"), ("/etc//passwd", "etc/passwd"), ('C:\\x*?"<>|', "Cx"), ("..", ""), ("a/./b/. ./c", "a/b/c"), ("é" * 200, "é" * 127), ("%ZZ+", "%ZZ+"), ("a/ .. /b", "a/b")])
def test_sanitise(dirty, want):
    assert P.sanitise(dirty) == want


def test_scrubbing_and_decoding():
    assert P.scrub_utf8(b"a\xc3b") == "a�b" and P.scrub_utf8(b"\xe2\x80a") == "��a" and P.scrub_utf8("é".encode()) == "é"
    assert P.percent_decoded("My%20Note%FF+%zz") == "My Note�+%zz"
    assert P.normalised_type("ﬁLE") == "file"
    assert len(P.keyed_hash("a", "k")) == 64


def test_minimal_edit():
    assert P.minimal_edit("abc😀def", "abc😀Xdef") == (5, 0, "X")
    assert P.minimal_edit("aaa", "aa") == (2, 1, "") and P.minimal_edit("x", "x") == (1, 0, "")


def test_frontmatter_round_trip():
    keys, values, reason = P.parsed_frontmatter("---\ntitle: A\nn: 3\nlist: [1, a]\n---\nbody")
    assert (keys, reason) == (["title", "n", "list"], None) and json.loads(values["list"]) == [1, "a"]
    again = P.emitted_frontmatter(keys, values, "body")
    assert P.parsed_frontmatter(again) == (keys, values, None) and again.endswith("---\nbody")
    assert P.parsed_frontmatter("---\n: [\n---\n")[2] == "frontmatter_invalid_yaml"
    assert P.parsed_frontmatter("---\n- a\n---\n")[2] == "frontmatter_invalid_yaml"
    assert P.parsed_frontmatter("none") == ([], {}, None)
    assert P.raw_spans("a: 1\na: 2") is None and P.raw_spans("a:\n  - x\nb: 1") == {"a": "a:\n  - x", "b": "b: 1"}


def test_occurrences_and_sections(spark):
    assert one(spark, T.replaced_occurrence(F.col("c"), "a.", "X", 1), c="a.ba.ca.") == "a.bXca."
    assert one(spark, T.replaced_occurrence(F.col("c"), "a.", "X", 5), c="a.b") == "a.b"
    assert one(spark, T.replaced_occurrence(F.col("c"), "a.", "X", -1), c="a.ba.") == "XbX"
    note = "# T\n## A\nold\n### deep\nx\n## B\nkeep"
    assert P.replaced_section(note, "## A", "new") == "# T\n## A\nnew\n## B\nkeep" and P.replaced_section(note, "## C", "n") is None
    assert one(spark, P.section_replaced(F.col("c"), "## B", "z"), c=note).endswith("## B\nz")
    assert one(spark, T.appended(F.col("c"), F.lit("t")), c="a\n\n") == "a\nt"
    assert one(spark, T.rendered(F.col("c"), F.lit("T"), F.array(F.lit("x"))), c="body") == "# T\n\nTags: x\n\nbody"


def test_sections_are_replaced_without_python(spark):
    lines = ["", "## A", " ## A\u2003", "## A b", "x## A", "# T", "### deep", "####### no", "##", "##\tB", "te$t \\1", "\r"]
    notes = ["\n".join(lines[i] for i in pick) for pick in [(), *((a, b, c, d) for a in range(12) for b in range(5) for c in range(0, 12, 3) for d in range(12))]]
    rows = spark.createDataFrame([(n,) for n in [*notes, None]], "c string")
    for heading, new in (("## A", "n$1\\w\nz"), ("# T", ""), ("A\\E b", "x"), ("", "y")):
        got = rows.select("c", T.section_replaced(F.col("c"), heading, new).alias("x"))
        assert all(r.x == (None if r.c is None else P.replaced_section(r.c, heading, new)) for r in got.collect())
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_links_are_found_in_arrow_batches(spark):
    notes = spark.createDataFrame([(1, "a [[b|c]] [d](e.md)"), (2, None), (3, ""), (4, "none"), (5, "é ![[f#g]]")], "note_id int, content string")
    plan = links.extract_links(notes)
    got = sorted((r.source_note_id, r.target, r.position, r.alias, r.anchor, r.link_type) for r in plan.collect())
    assert got == [(1, "b", 2, "c", None, "wikilink"), (1, "e.md", 10, "d", None, "wikilink"), (5, "f", 3, None, "g", "embed")]
    assert links.extract_links(notes.where("note_id = 2")).count() == 0
    batch = links._extract(pa.array(["[[b]]", None], pa.string()))
    assert batch.type == pa.list_(pa.struct(list(links._FIELDS.items()))) and len(batch) == 2


def test_chunks(spark):
    content = "---\ntags: [a]\n---\n# Hello\nintro\n\n## One\nétext\n### Deep\nmore\n## Two\n" + "word " * 1000
    rows = spark.createDataFrame([(1, "Test/Hello World.md", content), (2, "x.md", ""), (3, "y.md", "no heading"), (4, "z.md", None)], "note_id int, path string, content string")
    got = chunking.chunk_notes(rows).orderBy("note_id", "position").collect()
    mine = [r for r in got if r.note_id == 1]
    assert [r.heading_path for r in mine] == ["Hello", "Hello > One", "Hello > One > Deep", *["Hello > Two"] * 3, "frontmatter"]
    assert [r.position for r in mine] == list(range(7)) and mine[0].context_text == "Test > Hello\n\n# Hello\nintro"
    body = content.split("---\n", 2)[2].encode()
    assert body[mine[1].char_start : mine[1].char_end].decode().strip() == mine[1].text
    assert all(len(r.text.encode()) <= 2048 for r in mine) and (mine[-1].char_start, mine[-1].char_end) == (0, 0)
    assert " ".join(r.text for r in mine[3:6]) == ("## Two\n" + "word " * 1000).strip()
    assert [(r.note_id, r.heading_path, r.context_text) for r in got if r.note_id > 1] == [(3, "y", "y\n\nno heading")]
    assert len(chunking.chunked("```\n# no\n```\n# yes", "t", respect_fences=True)) == 2
    assert chunking.language_sample(chunking.chunk_notes(rows)).count() == 2


def test_tokens(spark):
    text = "Ünïted İstanbul z̵a don't 数据库x snake_case 3.14"
    assert one(spark, keyword.tokens(F.col("t"), normalise=True), t=text + " ﬁx") == ["ünïted", "istanbul", "za", "don", "t", "数据", "据库", "x", "snake_case", "3", "14", "fix"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("hoping", "hope"), ("sized", "size"), ("happy", "happi"), ("relational", "relat"), ("rationalization", "ration"), ("national", "nation"), ("hopefulness", "hope"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("generously", "generous"), ("communication", "communic"), ("skies", "sky"), ("dying", "die"), ("controlling", "control"), ("rate", "rate"), ("by", "by"), ("saying", "say"), ("consistency", "consist"), ("knightly", "knight"), ("sensational", "sensat")])
def test_stems(word, stem):
    assert stem_english(word) == stem


def test_links():
    text = "---\na: '[[no]]'\n---\né See [[Foo|shown]] ![[image.png]] [[Page#Heading]] `[[code]]` [l](<My file.md> \"t\") [m](a%20(b).md#An%20c) [x](https://e.com) [[ ]]"
    raw = text.encode()
    got = links.extracted(text)
    assert [(g[1], g[5], g[6], g[7], g[8]) for g in got] == [("Foo", "shown", None, "wikilink", "wiki"), ("image.png", None, None, "embed", "wiki"), ("Page", None, "Heading", "wikilink", "wiki"), ("My file.md", "l", None, "wikilink", "markdown"), ("a (b).md", "m", "An c", "wikilink", "markdown")]
    for position, _, target_raw, start, size, *_ in got:
        assert raw[start : start + size].decode() == target_raw and raw[position:position + 1] in b"[!"


def test_resolution_and_rewriting(spark):
    files = spark.createDataFrame([("v", 1, "a/Foo.md", "note"), ("v", 2, "b/deep/Foo.md", "note"), ("v", 3, "img.png", "attachment"), ("v", 4, "Node.js.md", "note"), ("w", 5, "Foo.md", "note"), ("v", 6, "Bar.md", "note")], "vault_id string, id int, path string, kind string")
    notes = spark.createDataFrame([("v", 6, "Bar.md", "Bar", "[[foo]] [[B/deep/foo]] [[img.png]] [[Node.js]] [[missing]] [t](b/deep/Foo.md) [[Foo.md]]")], "vault_id string, note_id int, path string, title string, content string")
    edges = links.extract_links(notes)
    resolved = links.resolve(edges, files)
    got = [(r.target, r.target_note_id, r.target_attachment_id, r.dangling) for r in resolved.orderBy("position").collect()]
    assert got == [("foo", 1, None, False), ("B/deep/foo", 2, None, False), ("img.png", None, 3, False), ("Node.js", 4, None, False), ("missing", None, None, True), ("b/deep/Foo.md", 2, None, False), ("Foo.md", 1, None, False)]
    assert {(r.target_note_id, r.source_path) for r in links.backlinks(resolved, notes).collect()} == {(1, "Bar.md"), (2, "Bar.md"), (4, "Bar.md")}
    assert [r.basename_key for r in links.danglers(resolved).collect()] == ["missing"]
    renames = spark.createDataFrame([(2, "b/New Name.md"), (1, "a/Foo2.md")], "note_id int, new_path string")
    after = files.where("id not in (1, 2)").union(spark.createDataFrame([("v", 2, "b/New Name.md", "note"), ("v", 1, "a/Foo2.md", "note")], files.schema))
    new = links.rewrite_notes(notes, resolved, renames, after).first()["content"]
    assert new == "[[Foo2]] [[b/New Name]] [[img.png]] [[Node.js]] [[missing]] [t](b/New%20Name.md) [[Foo2.md]]"
    assert [r[0] for r in links.affected_sources(resolved, renames).collect()] == [6]


def test_resolution_equals_brute_force(spark):
    paths = ["a/x.md", "b/x.md", "deep/er/x.md", "x.canvas", "a/x.png", "x.png", "a/X", "a/y.md.md", "y.md", "a/y", "a/b.c/z.md", "a/x.md.canvas", "n/note.md", "n/note"]
    files = [("v", i, p, "attachment" if p.endswith(".png") or i % 7 == 6 else "note") for i, p in enumerate(paths)] + [("w", 100, "a/x.md", "note")]
    targets = ["x", "X.md", "a/x", "A/x.md", "x.png", "a/x.png", "b/x.png", "y", "y.md", "a/y.md", "a/y", "a/y.md.md", "er/x", "b.c/z", "z", "a/x.md.canvas", "n/note", "none", "/x", None]
    frame = spark.createDataFrame(files, "vault_id string, id int, path string, kind string")
    edges = spark.createDataFrame([("v", 1, i, t) for i, t in enumerate(targets)], "vault_id string, source_note_id int, position int, target string").withColumn("basename_key", T.basename_key(F.col("target")))
    key = lambda p: re.sub(r"\.(md|canvas)$", "", p.lower().split("/")[-1])

    def best(target):
        name = (target or "").split("/")[-1]
        notes_first = "." not in name[1:] or name.lower().endswith((".md", ".canvas"))
        low = (target or "").lower()
        found = [(notes_first != (k == "note"), len(p), p, i) for v, i, p, k in files if v == "v" and target is not None and key(p) == key(target) and ("/" not in target or p.lower() in (low, low + ".md", low + ".canvas"))]
        return min(found)[3] if found else None

    resolved = links.resolve(edges, frame)
    got = [(r.target, r.target_note_id if r.target_note_id is not None else r.target_attachment_id, r.dangling) for r in resolved.orderBy("position").collect()]
    assert got == [(t, best(t), best(t) is None) for t in targets]
    notes = spark.createDataFrame([("v", 1, "[[x]] [[a/x]]")], "vault_id string, note_id int, content string")
    plan = links.resolve(links.extract_links(notes), frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
