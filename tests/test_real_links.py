"""Links of texts made of pieces whose links, places and targets are known, against extraction, resolution and rewriting."""

import random

from folioflow.operators import links
from folioflow.plans import QUERIES

#: piece, then target, raw target, place of the raw target in the piece (bytes), alias, anchor, type and form; or no link
PIECES = [
    ("Zoë 😀 said ", None),
    ("\n\n## Head [x] (y)\n", None),
    ("[[Alpha]]", ("Alpha", "Alpha", 2, None, None, "wikilink", "wiki")),
    ("[[ beta | shown ]]", ("beta", "beta", 3, "shown", None, "wikilink", "wiki")),
    ("![[Pic.PNG|é]]", ("Pic.PNG", "Pic.PNG", 3, "é", None, "embed", "wiki")),
    ("[[sub/alpha#Part|p]]", ("sub/alpha", "sub/alpha", 2, "p", "Part", "wikilink", "wiki")),
    ("[[sub/Gamma.md]]", ("sub/Gamma.md", "sub/Gamma.md", 2, None, None, "wikilink", "wiki")),
    ("[Ü](<my note.md>)", ("my note.md", "my note.md", 6, "Ü", None, "wikilink", "markdown")),
    ("[m](my%20note.md#An%20c)", ("my note.md", "my%20note.md", 4, "m", "An c", "wikilink", "markdown")),
    ("![i](pic.png)", ("pic.png", "pic.png", 5, "i", None, "embed", "markdown")),
    ("[[nowhere]]", ("nowhere", "nowhere", 2, None, None, "wikilink", "wiki")),
    ("[out](https://example.org/alpha.md)", None),
    ("[mail](mailto:a@example.org)", None),
    ("[[#Head]]", None),
    ("[[|a]]", None),
    ("`[[Alpha]]`", None),
    ("\n```\n[[Alpha]] [m](beta.md)\n```\n", None),
    ("\n~~~\n[[beta]]\n~~~\n", None),
]
FILES = [(1, "Alpha.md", "note"), (2, "sub/Alpha.md", "note"), (3, "deep/er/beta.md", "note"), (4, "z/Beta.md", "note"), (5, "sub/gamma.md", "note"), (6, "my note.md", "note"), (7, "img/pic.png", "attachment"), (8, "pic.png.md", "note"), (9, "Beta.canvas", "note")]


def made(rng):
    """A text and its links (position, then as in PIECES)."""
    text, found = "---\ntitle: '[[Alpha]]'\n---\n" if rng.random() < 0.3 else "", []
    for piece, link in rng.choices(PIECES, k=rng.randint(0, 25)):
        text += " "
        at = len(text.encode())
        text += piece
        if link:
            found.append((at, link[0], link[1], at + link[2], len(link[1].encode()), *link[3:]))
    return text, found


def bare(path):
    name = path.rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[0] if name.endswith((".md", ".canvas")) else name


def goal(target, files):
    """Every file is looked at for every link."""
    low = target.lower()
    name = low.rsplit("/", 1)[-1]
    ending = name[name.rfind(".") :] if name.rfind(".") > 0 else ""
    first = "note" if ending in ("", ".md", ".canvas") else "attachment"
    if "/" in target:
        hit = [f for f in files if low in (f[1].lower(), *(f[1].lower().removesuffix(e) for e in (".md", ".canvas") if f[1].lower().endswith(e)))]
    else:
        hit = [f for f in files if bare(f[1]) == bare(target)]
    return min(hit, key=lambda f: (f[2] != first, len(f[1]), f[1]), default=(None, None, None))


def notes_of(spark, seed, n=150):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(n)]
    rows = spark.createDataFrame([(100 + i, "v", f"n{i}.md", t[0]) for i, t in enumerate(texts)], "note_id bigint, vault_id string, path string, content string")
    return texts, rows


def test_places_and_fields():
    rng = random.Random(5)
    for _ in range(2_000):
        text, want = made(rng)
        assert links.extracted(text) == want
    for text in ("", "[[", "[[a", "[[a]", "[](", "[a]()", "![[]]", "[[[a]]", "`[[a]]", "```\n[[a]]"):
        links.extracted(text)
    assert len(links.extracted("[[Alpha]] x " * 100_000)) == 100_000


def test_targets_are_brute_force(spark):
    texts, rows = notes_of(spark, 6)
    files = spark.createDataFrame([("v", *f) for f in FILES], "vault_id string, id bigint, path string, kind string")
    got = links.resolve(links.extract_links(rows), files).collect()
    key = lambda r: (r.source_note_id, r.position)
    assert {key(r): (r.target_note_id, r.target_attachment_id, r.target_path, r.dangling) for r in got} == {
        (100 + i, at): (g[0] if g[2] == "note" else None, g[0] if g[2] == "attachment" else None, g[1], g[0] is None)
        for i, (_, found) in enumerate(texts)
        for at, target, *_ in found
        for g in [goal(target, FILES)]
    }
    assert len(got) == sum(len(f) for _, f in texts)


def test_rewritten_links_reach_the_moved_note(spark):
    texts, rows = notes_of(spark, 7)
    moved = {1: "new/First note.md", 5: "other/Gamma.md", 6: "new/mine #2.md"}
    after = [(i, moved.get(i, p), k) for i, p, k in FILES]
    frame = lambda files: spark.createDataFrame([("v", *f) for f in files], "vault_id string, id bigint, path string, kind string")
    resolved = links.resolve(links.extract_links(rows), frame(FILES))
    renames = spark.createDataFrame(list(moved.items()), "note_id bigint, new_path string")
    got = {r.note_id: r.content for r in links.rewrite_notes(rows, resolved, renames, frame(after)).collect()}
    changed = 0
    for i, (text, found) in enumerate(texts):
        before = [goal(f[1], FILES)[0] for f in found]
        assert (100 + i in got) == any(g in moved for g in before)
        now = links.extracted(got.get(100 + i, text))
        assert len(now) == len(found)
        for old, new, was in zip(found, now, before, strict=True):
            assert new[5:] == old[5:]
            if was in moved:
                changed += 1
                assert goal(new[1], after)[0] == was
            else:
                assert new[1:3] == old[1:3]
    assert changed > 50


def test_queries_take_the_links_of_the_texts(spark, tmp_path):
    rng = random.Random(8)
    texts = [made(rng) for _ in range(60)]
    rows = [(i, t[0].replace("---\n", ""), "web" if i % 2 else "book", "en", len(t[0])) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["outgoing_links"](spark, str(tmp_path)).collect():
        got[r.source_note_id] = max(got.get(r.source_note_id, 0), r.place)
    want = {i: len(links.extracted(r[1])) + 2 for i, r in enumerate(rows)}
    assert got == want and sum(want.values()) > 300
