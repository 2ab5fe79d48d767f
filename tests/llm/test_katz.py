import math
import re
import zlib
from collections import Counter

from pitgrid.llm import katz


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w))
    heads = Counter()
    for (h, _), c in two.items():
        heads[h] += c
    total, types = sum(one.values()), len(one)
    n = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, katz.LOW + 2)]
    d1, d2 = katz.discounts(n(one), 1), katz.discounts(n(two), 2)
    f = lambda d, c: d[c] if c <= katz.LOW else 1.0
    p1 = {w: f(d1, c) * c / total for w, c in one.items()}
    unseen = 1 - sum(p1.values())
    if unseen <= 1e-12:
        p1 = {w: p * total / (total + 1) for w, p in p1.items()}
        unseen = 1 / (total + 1)
    kept = {}
    for (h, w), c in two.items():
        if c >= 2:
            kept.setdefault(h, {})[w] = f(d2, c) * c / heads[h]
    for h, ws in kept.items():
        if sum(ws.values()) > 1 - 1e-9:
            kept[h] = {w: p * heads[h] / (heads[h] + 1) for w, p in ws.items()}
    alpha = {h: (1 - sum(ws.values())) / (1 - sum(p1[w] for w in ws)) for h, ws in kept.items()}
    for h, ws in kept.items():  # each distribution adds up to one
        rest = unseen + sum(p for w, p in p1.items() if w not in ws)
        assert abs(sum(ws.values()) + alpha[h] * rest - 1) < 1e-9
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w)
        s = 0.0
        for h, x in zip(["<s>", *w[:-1]], w):
            s += math.log10(kept.get(h, {}).get(x) or alpha.get(h, 1.0) * p1.get(x, unseen))
        out.append((i, held[i], len(w), sum(one[x] > 0 for x in w), total, base, s))
    return out


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "The the THE"), (None, "a b a b a b"), (-3, "The the THE")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    want = sorted(brute(rows), key=str)
    for size in (1 << 40, 50_000):
        got = sorted((tuple(r) for r in katz.score(df, shard_bytes=size).collect()), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6, (a, b)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert katz.score(df.limit(0)).count() == 0
    assert katz.score(df).first().n_tokens == 1


def test_packing():
    import numpy as np

    for x in (np.empty(0, np.uint64), np.array([3, 2**63, 5], np.uint64), np.arange(9, dtype=np.uint32)):
        assert (katz.unpacked(katz.packed(x), x.dtype) == x).all()
        assert (katz.summed(katz.deltas(np.sort(x)), x.dtype) == np.sort(x)).all()


def brute_keeping_all(rows):
    """Scores with the pairs that training has once in the table, by document, and the pairs' discounts."""
    one, two, held = Counter(), Counter(), {}
    for i, t in rows:
        held[i] = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        if not held[i]:
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w))
    n = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, katz.LOW + 2)]

    def good_turing(c):
        m, d = n(c), {}
        share = (katz.LOW + 1) * m[katz.LOW + 1] / m[1]
        for r in range(1, katz.LOW + 1):
            made = ((r + 1) * m[r + 1] / m[r] / r - share) / (1 - share) if m[r] and share < 1 else 1.0
            d[r] = made if 0 < made < 1 else 1.0
        return d

    d1, d2, total = good_turing(one), good_turing(two), sum(one.values())
    p1 = {w: d1.get(c, 1.0) * c / total for w, c in one.items()}
    unseen = 1 - sum(p1.values())
    after = {}
    for (h, w), c in two.items():
        after.setdefault(h, {})[w] = c
    p2, alpha = {}, {}
    for h, ws in after.items():
        whole = sum(ws.values())
        p2[h] = {w: d2.get(c, 1.0) * c / whole for w, c in ws.items()}
        if sum(p2[h].values()) > 1 - 1e-9:
            p2[h] = {w: p * whole / (whole + 1) for w, p in p2[h].items()}
        alpha[h] = (1 - sum(p2[h].values())) / (1 - sum(p1[w] for w in ws))
    assert unseen > 1e-12
    score = lambda w: sum(math.log10(p2.get(h, {}).get(x) or alpha.get(h, 1.0) * p1.get(x, unseen)) for h, x in zip(["<s>", *w[:-1]], w))
    return {i: score(tokens(t)) for i, t in rows}, d2


def test_query_keeps_pairs_seen_once(spark):
    from pitgrid.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, d2 = brute_keeping_all(rows)
    assert 0 < d2[1] < 1
    got = {r.doc_id: r.score for r in queries.op9_lm_scores(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
