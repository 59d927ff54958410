"""The kept link graph after random batches against all links resolved anew."""

import random

from pyspark.sql import functions as F

from folioflow.operators import links
from folioflow.operators.link_graph import LinkGraph

FILE = "vault_id string, id bigint, kind string, old_path string, path string"
NOTE = "vault_id string, note_id bigint, content string"
FIELDS = ["vault_id", "source_note_id", "position", "target", "target_note_id", "target_attachment_id", "target_path", "dangling"]


def batch_of(rng, live, texts, size):
    """A random batch, applied to ``live`` (vault, kind, id -> path) and ``texts`` (vault, note -> content)."""
    before = dict(live)
    some = lambda: rng.choice(["a", "B", "c", "Note", "x y"])
    link = lambda: rng.choice([f"[[{some()}]]", f"[[d/{some()}|s]]", f"[m](<{some()}.md>)", f"![[{some()}.png]]", f"`[[{some()}]]`"])
    contents = {}
    for _ in range(size):
        vault, kind = rng.choice(["v", "w"]), rng.choice(["note", "note", "attachment"])
        key = (vault, kind, rng.randint(1, 25))
        if rng.random() < 0.3:
            live.pop(key, None)
            if kind == "note":
                texts.pop((vault, key[2]), None)
                contents.pop((vault, key[2]), None)
        else:
            live[key] = rng.choice(["", "d/", "e/D/"]) + some() + (".md" if kind == "note" else ".png")
            if kind == "note" and (rng.random() < 0.6 or (vault, key[2]) not in texts):
                texts[vault, key[2]] = contents[vault, key[2]] = rng.choice([None, "", " ".join(link() for _ in range(rng.randint(0, 9)))])
    changes = [(*k[:1], k[2], k[1], before.get(k), live.get(k)) for k in sorted(before.keys() | live.keys()) if before.get(k) != live.get(k)]
    return changes, [(*k, c) for k, c in contents.items()]


def test_random_batches(spark, tmp_path):
    rng, live, texts = random.Random(3), {}, {}
    graph = LinkGraph(spark, f"{tmp_path}/graph", buckets=4)
    for number in range(4):
        changes, contents = batch_of(rng, live, texts, 120 if number == 0 else 12)
        files, notes = spark.createDataFrame(changes, FILE), spark.createDataFrame(contents, NOTE).withColumn("basename_key", F.lit("clash"))
        for _ in range(2 if number % 2 else 1):
            assert graph.apply(files, notes, number) == number
        all_files = spark.createDataFrame([(k[0], k[2], k[1], p) for k, p in live.items()], "vault_id string, id bigint, kind string, path string")
        all_notes = spark.createDataFrame([(*k, c) for k, c in texts.items()], NOTE)
        want = links.resolve(links.extract_links(all_notes), all_files).select(*FIELDS).collect()
        assert sorted(map(repr, graph.edges.read().select(*FIELDS).collect())) == sorted(map(repr, want))
        assert graph.files.read().count() == len(live)
    assert len(want) > 20


def test_batch_that_broke_off_and_untouched_folders(spark, tmp_path):
    graph = LinkGraph(spark, f"{tmp_path}/graph", buckets=16)
    files = [("v", i, "note", None, f"n{i}.md") for i in range(40)]
    graph.apply(spark.createDataFrame(files, FILE), spark.createDataFrame([("v", i, f"[[n{(i + 1) % 40}]]") for i in range(40)], NOTE), 1)
    kept = {r["f"] for r in graph.edges.manifest().select(F.concat_ws("/", "_bucket", "_batch").alias("f")).collect()}
    broken, graph.names.replace = graph.names.replace, None
    change = spark.createDataFrame([("v", 5, "note", "n5.md", "m5.md"), ("v", 7, "note", "n7.md", None)], FILE), spark.createDataFrame([], NOTE)
    try:
        graph.apply(*change, 2)
        raise AssertionError
    except TypeError:
        graph.names.replace = broken
    graph.apply(*change, 2)
    got = {r.source_note_id: r.target_note_id for r in graph.edges.read().collect()}
    assert got == {i: (None if i in (4, 6) else (i + 1) % 40) for i in range(40) if i != 7}
    now = {r["f"] for r in graph.edges.manifest().select(F.concat_ws("/", "_bucket", "_batch").alias("f")).collect()}
    # the names n5, m5, n7 and n8, which the note that went had asked for
    assert len(now - kept) <= 4 and len(now & kept) >= len(kept) - 4
