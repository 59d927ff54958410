import math
import random
import zlib

import numpy as np

from folioflow.llm import toxicity as T


def corpus(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 8))]
        toxic = int(r.random() < 0.3)
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(["idiot", "Clown,", "LOSER"])
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def test_held_out_accuracy_and_sentences(spark, documents):
    rows = corpus(1200)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (5, 0, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in T.predict(documents([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")]), labels).collect()}
    for i in got:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score and got[5000].predicted == 0
    model = T.fit(documents([(i, t) for i, t, _ in rows]), labels)
    text = "Abc dab é. You are an idiot! Bcd."
    spot = T.locate(documents([(1, text)]), model).collect()
    assert [text.encode()[r.start_byte : r.end_byte].decode() for r in spot] == ["You are an idiot"]


def test_scores_are_noisy_or_of_sentences():
    table = np.random.default_rng(0).normal(size=T.SLOTS)
    texts = [b"one two. three! four\nfive", b"", b"  ..", b"six"]
    got = T.score_texts(texts, table, -1.0)
    word = lambda w: table[int(T.split([w.encode()])[0][0])]
    p = lambda *ws: 1 / (1 + np.exp(1.0 - sum(map(word, ws))))
    want = [1 - (1 - p("one", "two")) * (1 - p("three")) * (1 - p("four")) * (1 - p("five")), 0, 0, p("six")]
    assert np.allclose(got, want)


def test_without_telling_labels(spark, documents, odd):
    docs = documents(list(enumerate(odd)) + [(None, "a"), (1, "")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = T.predict(docs, none).collect()
    assert len(got) == len(odd) + 2 and all(0 <= r.score < 1e-6 and r.predicted == 0 for r in got)
    assert T.predict(documents([]), none).count() == 0


def rare_corpus(n, seed=4):
    """One document in ten is toxic, by one of sixty words that are each rare; clean ones hold them at times as well."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    slurs = [f"zz{word()}{k}x" for k in range(60)]
    slurs = ["".join(chr(ord("i") + int(c)) if c.isdigit() else c for c in s) for s in slurs]
    rows = []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 12))]
        toxic = int(r.random() < 0.1)
        if toxic or r.random() < 0.01:
            sentences[r.randrange(len(sentences))] += " " + r.choice(slurs)
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def test_half_parts_rare_toxic_words(spark, documents):
    rows = rare_corpus(8000)
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id bigint, quality int, toxic int")
    docs = documents([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r.predicted for r in T.predict(docs, labels).collect()}
    kept = {r.doc_id for r in T.reject(docs, labels).collect()}
    assert kept == {i for i in got if not got[i]}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic, clean = [p for p, y in held if y], [p for p, y in held if not y]
    assert sum(toxic) / len(toxic) >= 0.8 and 1 - sum(clean) / len(clean) >= 0.9


def brute_loss(bags, labels, slots, weights, bias):
    weight = {int(s): w for s, w in zip(slots, weights)}
    each = {1: 0.5 / sum(labels), 0: 0.5 / (len(labels) - sum(labels))}
    loss = 0.5 * T.DECAY * sum(w * w for w in weights)
    for bag, y in zip(bags, labels):
        z, none = [], 1.0
        for x in np.frombuffer(bag, np.uint32).tolist():
            if x >= 1 << 31:
                z.append(bias)
            z[-1] += weight.get(x % (1 << 31), 0.0)
        for s in z:
            none *= 1 - 1 / (1 + math.exp(-s))
        loss -= each[y] * math.log(max(1 - none if y else none, 1e-300))
    return loss


def test_fit_is_an_optimum_of_the_brute_force_likelihood():
    rows = corpus(400, seed=7)
    for k in range(0, 400, 9):  # some labels are wrong, so that the optimum is finite
        rows[k] = (rows[k][0], rows[k][1], 1 - rows[k][2])
    bags, labels = [T.pack(t.encode()) for _, t, _ in rows], [y for *_, y in rows]
    model = T.train(bags, np.array(labels))
    held = {x % (1 << 31) for b in bags for x in np.frombuffer(b, np.uint32).tolist()}
    counts = {s: [sum(y == want for b, y in zip(bags, labels) if s in {x % (1 << 31) for x in np.frombuffer(b, np.uint32).tolist()}) for want in (0, 1)] for s in held}
    part = lambda k, m: (k * math.log(k / m) if k else 0) + ((m - k) * math.log(1 - k / m) if m > k else 0)
    n, toxic = len(labels), sum(labels)
    told = {s: 2 * (part(b, a + b) + part(toxic - b, n - a - b) - part(toxic, n)) for s, (a, b) in counts.items()}
    assert set(model.slots.tolist()) == {s for s, t in told.items() if t >= T.MIN_GAIN}
    best = brute_loss(bags, labels, model.slots, model.weights, model.bias)
    for k in range(len(model.weights) + 1):
        for step in (-0.2, 0.2):
            w, b = model.weights.copy(), model.bias
            if k < len(w):
                w[k] += step
            else:
                b += step
            assert brute_loss(bags, labels, model.slots, w, b) > best - 2e-4


def test_scale_keeps_the_noisy_or_and_the_order():
    bags = [T.pack(t.encode()) for t in ["a b. idiot c", "a. b", "idiot", "", "c c. d"] * 20]
    labels = np.array([1, 0, 1, 0, 0] * 20)
    model = T.train_calibrated(bags, labels)
    scores = T.score_texts([b"a b. idiot c", b"a. b", b"", b"idiot. idiot"], model.table(), model.bias, model.power)
    assert scores[0] >= 0.5 > scores[1] > scores[2] == 0
    one = T.score_texts([b"idiot"], model.table(), model.bias, model.power)[0]
    assert np.isclose(scores[3], 1 - (1 - one) ** 2)


def test_repeated_ids_don_t_lengthen_the_sample(spark, documents):
    docs = documents([(i % 5, f"w{'abcdefghij'[i % 10]} x") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)], "doc_id bigint, quality int, toxic int")
    seen = []
    real = T.train_calibrated
    T.train_calibrated = lambda bags, y: seen.append(len(bags)) or real(bags, y)
    try:
        T.fit(docs, labels)
    finally:
        T.train_calibrated = real
    assert seen == [5]


def test_driver_gets_telling_words_only(spark, documents, monkeypatch):
    """The same model as from whole bags, though few of their words travel."""
    rows = [(i, text + " filler of words that tell nothing" * 20, toxic) for i, text, toxic in corpus(900)]
    whole = [T.pack(text.encode()) for _, text, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(whole[i]), rows[i][2]))
    want = T.train_calibrated([whole[i] for i in order], np.array([rows[i][2] for i in order]))
    seen, train = [], T.train_calibrated
    monkeypatch.setattr(T, "train_calibrated", lambda bags, toxic: seen.append(sum(map(len, bags))) or train(bags, toxic))
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id bigint, quality int, toxic int")
    got = T.fit(documents([(i, text) for i, text, _ in rows]).repartition(5), labels)
    assert len(seen) == 1 and seen[0] < 0.2 * sum(map(len, whole))
    assert got.slots.tolist() == want.slots.tolist() and len(want.slots) and got.weights.tolist() == want.weights.tolist()
    assert (got.bias, got.power) == (want.bias, want.power)


def test_fit_keeps_within_its_bytes(spark, documents, monkeypatch):
    """Bags are left out beyond FIT_BYTES of whole words, in the order of the hash, as before thinning."""
    rows = corpus(300)
    bags = {i: T.pack(text.encode()) for i, text, _ in rows}
    monkeypatch.setattr(T, "FIT_BYTES", sum(map(len, bags.values())) // 2)
    seen = []
    monkeypatch.setattr(T, "train_calibrated", lambda bags, toxic: seen.append(toxic))
    T.fit(documents([(i, text) for i, text, _ in rows]), spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id bigint, quality int, toxic int"))
    order = [r.id for r in spark.range(300).selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").collect()]
    kept, total = [], 0
    for i in order:
        total += len(bags[i])
        if total <= T.FIT_BYTES:
            kept.append(i)
    label = {i: t for i, _, t in rows}
    assert seen[0].tolist() == [label[i] for i in sorted(kept, key=lambda i: (zlib.crc32(bags[i]), label[i]))]
