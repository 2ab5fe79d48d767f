import math
import random
from collections import Counter

from pitgrid.llm import spm

TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tline\n\nx", "日本語 ñandú ﬁ 🙂​", "word " * 4000, "z" * 5000, "Erinst resh."]


def codec():
    return spm.codec(spm.default_path(), spm.ALPHA)


def test_encoding_and_round_trip(spark):
    random.seed(2)
    texts = TEXTS[1:] + ["".join(random.choice("abc  \n\tÉé日🙂<s>.") for _ in range(70)) for _ in range(2000)]
    c = codec()
    for t in texts:
        assert spm.as_ids(c.encode(t)).tolist() == c.model.encode(t), t[:60]
        assert c.decode(c.encode(t)) == t
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in spm.decode(spm.encode(df)).collect()} == dict(enumerate(TEXTS))


def every(unit, c):
    """All segmentations of a unit and their log weights."""
    lattice = spm.Lattice(unit, c)

    def walk(p):
        if p == len(unit):
            yield (), 0.0
        else:
            for end, ids, s in lattice.arcs[p]:
                for rest, w in walk(end):
                    yield tuple(ids) + rest, s + w

    return dict(walk(0))


def test_samples_against_enumeration():
    c = spm.Codec(spm.default_path(), 0.0003)
    text = "the reon"
    units, told = c.read(text)
    weights = {(): 0.0}
    for u in units:
        weights = {a + b: x + y for a, x in weights.items() for b, y in every(u, c).items()}
    z = math.log(sum(map(math.exp, weights.values())))
    first, pair = Counter(), Counter()
    for i in range(3000):
        drawn = c.sample(units, told, 3, spm.row_rng(i, 1))
        segs = [tuple(spm.as_ids(d[0]).tolist()) for d in drawn]
        assert len(set(segs)) == 3 and drawn[0][2] >= drawn[1][2] >= drawn[2][2]
        for s, d in zip(segs, drawn):
            assert abs(d[1] - (weights[s] - z)) < 1e-9 and 0 < d[3] <= 1
        first[segs[0]] += 1
        pair[segs[0], segs[1]] += 1
    p = {s: math.exp(w - z) for s, w in weights.items()}
    for s, q in p.items():
        assert abs(first[s] / 3000 - q) < 5 * math.sqrt(q / 3000) + 1e-3
    for (a, b), n in pair.most_common(5):
        q = p[a] * p[b] / (1 - p[a])
        assert abs(n / 3000 - q) < 5 * math.sqrt(q / 3000) + 1e-3


def test_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in list(enumerate(TEXTS)) + [(None, "x y")]], "doc_id long, text string, samples int")
    got = spm.digest(df.union(df)).collect()
    assert len(got) == 2 * (len(TEXTS) + 1) and all(r.round_trip for r in got)
    assert len({(r.doc_id, str(r.samples)) for r in got}) == len(TEXTS) + 1
    assert [len(r.samples) for r in got if r.doc_id == 0] == [1, 1]
    full = spm.sample(df).where("doc_id = 9").orderBy("rank").collect()
    short = next(r.samples for r in got if r.doc_id == 9)
    assert [len(r.ids) for r in full] == [s.n_tokens for s in short] and [r.log_prob for r in full] == [s.log_prob for s in short]
    assert spm.digest(df.limit(0)).count() == 0
