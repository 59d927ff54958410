import math
import random
import re
from collections import defaultdict

import pytest

from folioflow.llm import common
from folioflow.llm import url_filter as U


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), h), re.match("[^?#]*", rest[len(h) :])[0]


def fitting(h, p):
    fits = [(len(a + b), a + b, v) for v, a, b in U.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows, labels):
    bad = {}
    for i, b in labels:
        if b in (0, 1) and i is not None:
            bad[i] = max(b, bad.get(i, 0))
    pages = [(i, *cut(u)) for i, u in rows]
    segs = {}
    for _, h, p in pages:
        parts = [s for s in p.split("/") if s]
        segs[h, p] = parts[: U.DEPTH] + (["/".join(parts[U.DEPTH :])] if len(parts) > U.DEPTH else [])
    name = {k: "" for k in segs}
    for level in range(U.DEPTH + 1):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for i, h, p in pages:
            if level < len(segs[h, p]):
                c = nodes[h, name[h, p]][segs[h, p][level]]
                c[0] += 1
                c[1] += i in bad
                c[2] += bad.get(i, 0)
        choice = {}
        for node, children in nodes.items():
            total = sum(c[0] for c in children.values())
            variable = {s for s, c in children.items() if len(children) >= U.MANY and c[0] < U.SHARE * total}
            rest = {s: c for s, c in children.items() if s not in variable}
            n, k = sum(c[1] for c in rest.values()), sum(c[2] for c in rest.values())
            for s, c in children.items():
                if s in variable:
                    choice[node, s] = "*"
                else:
                    similar = c[1] == 0 or n == 0 or abs(c[2] / c[1] - k / n) <= U.CHANCE * math.sqrt(k / n * (1 - k / n) / c[1])
                    choice[node, s] = "~" if len(rest) > 1 and similar else s
        name = {(h, p): t + (f"/{choice[(h, t), segs[h, p][level]]}" if level < len(segs[h, p]) else "") for (h, p), t in name.items()}
    known = [bad[i] for i, _, _ in pages if i in bad]
    base = sum(known) / len(known) if known else 0
    stats = defaultdict(lambda: [0, 0])
    for i, h, p in pages:
        stats[h, name[h, p]][0] += i in bad
        stats[h, name[h, p]][1] += bad.get(i, 0)
    out = []
    for i, h, p in pages:
        n, k = stats[h, name[h, p]]
        purity = (k + U.PRIOR_WEIGHT * base) / (n + U.PRIOR_WEIGHT)
        r, verdict = fitting(h, p)
        out.append((i, h, p, r, verdict or ("block" if purity >= U.PURITY else "allow"), name[h, p], round(purity, 9)))
    return sorted(out, key=str)


def answer(spark, rows, labels):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id bigint, url string, html string, pages int")
    marks = spark.createDataFrame([(i, b, "x") for i, b in labels], "page_id bigint, bad int, url string")
    return sorted(((*r[:6], round(r[6], 9)) for r in U.judge(pages, marks).collect()), key=str)


@pytest.mark.parametrize("hot", [1, 100])
def test_same_as_brute_force(spark, monkeypatch, hot):
    """With ``hot`` 1, keys of more than a row are joined as hot ones."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_SHARE", 10_000 if hot == 1 else 4)
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        kind = r.choice(["news", "shop", "spam", "a/b/c/d/e/f"])
        url = f"https://{r.choice(['www.', '', 'M.'])}{r.choice(['site.test', 'Example.ORG', 'example.com', 'big.test', 'big.test'])}/{r.choice(['en', 'de', 'fr'])}/{kind}/{r.randint(0, 90)}{r.choice(['', '?q=1', '#x', '/'])}"
        rows.append((i, url))
        if r.random() < 0.7:
            labels.append((i, int(r.random() < (0.95 if kind == "spam" else 0.1))))
    rows += [(700, None), (701, ""), (702, "no scheme"), (703, "http://"), (704, "x://HOST"), (705, "a://b?c/d"), (706, "http://example.net"), (707, "http://a.example.net/en/1"), (708, "http://example.net/"), (None, "http://b.test/é/ü"), (3, rows[3][1]), (710, "ftp://h/a//b://c")]
    labels += [(3, 1), (3, 0), (None, 1), (9, None), (10, 7)]
    got, want = answer(spark, rows, labels), brute(rows, labels)
    assert got == want
    assert {g[4] for g in got} == {"allow", "block"}
    assert any(g[3] is None and g[4] == "block" for g in got) and any("*" in g[5] for g in got) and any("~" in g[5] for g in got)


def test_empty_tables(spark):
    assert answer(spark, [], []) == []
    assert answer(spark, [(1, "http://a.com/b")], [])[0][4] == "allow"


def test_one_url_on_most_pages(spark):
    rows = [(i, "http://one.test/a/b") for i in range(900)] + [(None, "http://one.test/a/b")] * 300 + [(i, f"http://one.test/a/{i}") for i in range(900, 1000)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 1000, 2)]
    assert answer(spark, rows, labels) == brute(rows, labels)
