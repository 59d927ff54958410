import random
from pathlib import Path

import pytest

from folioflow.sources.upsert import UpsertTable


def table(spark, root, buckets=4):
    return UpsertTable(spark, f"file://{root}", "id bigint, note_id string, vault_id string, dense array<double>", buckets=buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, note_id string, vault_id string, dense array<double>")


def contents(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def files(root):
    return {p for p in Path(root, "data").rglob("part-*.parquet")}


def test_random_batches_by_row_and_by_note(spark, tmp_path):
    r, store, kept = random.Random(1), table(spark, tmp_path / "st ore"), {}
    assert store.version() == -1 and store.read().count() == 0 and store.vacuum() == 0
    for batch in range(5):
        rows = [(r.randrange(12), f"n{r.randrange(5)}", r.choice(["a", "b", None]), [float(batch), float(k)]) for k in range(8)]
        if batch % 2:
            notes = {(v, n) for _, n, v, _ in rows}
            kept = {k: x for k, x in kept.items() if (k[0], k[1]) not in notes}
            rows = list({(v, n, i): (i, n, v, d) for i, n, v, d in rows}.values())
            store.upsert(frame(spark, rows), batch)
            kept |= {(v, n, i): (i, n, v, d) for i, n, v, d in rows}
        else:
            store.upsert(frame(spark, rows), batch, on=["note_id", "id"])
            for i, n, v, d in rows:
                old = kept.get((v, n, i))
                kept[v, n, i] = (i, n, v, d) if old is None or old[3][0] < batch else max(old, (i, n, v, d), key=lambda x: x[3])
        assert contents(store.read()) == sorted(tuple(map(str, x)) for x in kept.values()), batch
    gone = next(iter(kept))
    store.delete(spark.createDataFrame([(gone[0], gone[1])], "vault_id string, note_id string"), 9)
    kept = {k: x for k, x in kept.items() if k[:2] != gone[:2]}
    assert contents(store.read()) == sorted(tuple(map(str, x)) for x in kept.values())
    assert store.vacuum() > 0 and contents(store.read()) == sorted(tuple(map(str, x)) for x in kept.values())


def test_untouched_files_stay_replays_change_nothing_and_readers_keep_their_version(spark, tmp_path):
    store = table(spark, tmp_path)
    store.upsert(frame(spark, [(i, f"n{i}", "big" if i % 2 else "small", [float(i)]) for i in range(40)]), 1)
    first, before, reader = contents(store.read()), files(tmp_path), store.read()
    assert store.upsert(frame(spark, [(1, "n1", "big", [9.0])]), 2) == 2
    new = files(tmp_path) - before
    assert before <= files(tmp_path) and len({p.parent for p in new}) == 1
    assert contents(reader) == first and contents(store.read(1)) == first and contents(store.read()) != first
    after, there = contents(store.read()), files(tmp_path)
    assert store.upsert(frame(spark, [(1, "n1", "big", [9.0])]), 2) == 2 and store.upsert(frame(spark, [(5, "n5", "big", [0.0])]), 1) == 2
    assert contents(store.read()) == after and files(tmp_path) == there
    with pytest.raises(ValueError):
        store.upsert(frame(spark, []), 3, on=["id"])
    assert store.upsert(frame(spark, []), 3) == 3 and contents(store.read()) == after
