import random
import re
from collections import Counter, defaultdict

import pytest

from pitgrid.llm import collocations

SF = "/root/testdata/sf0.001"


def plain(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sample", [1, 10_000])
def test_against_plain_counts(spark, monkeypatch, sample):
    monkeypatch.setattr(collocations, "SAMPLE_ROWS", sample)
    random.seed(5)
    words = ["the", "The", "of", "Zé", "xx\xa0y", "w" * 40, "日本", "#", "", "\t", "a.b", "\x0b"]
    rows = [(random.choice([None, "und", "en", "de"]), " ".join(random.choices(words, [9, 5, 9, 4, 3, 3, 3, 2, 2, 1, 1, 1], k=random.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, "\n"), ("fr", "solo"), ("en", "the of xx " * 700)]
    docs = spark.createDataFrame([(i, lang, t, 1, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    for least, share, top in ((10, 50, 2000), (2, 90, 7)):
        got = [tuple(r) for r in collocations.collocations(docs, least, share, top).collect()]
        assert sorted(got) == plain(rows, least, share, top)


def test_large_counts_stay_exact(spark):
    e = "1000000 * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    row = spark.sql(f"select {e} as s from (select 4000000000000001L as a, 4000000000000007L as l, 4000000000000003L as r)").first()
    assert row.s == 1000000 * 4000000000000001**2 // (4000000000000007 * 4000000000000003)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "en"), (2, "", None)], "doc_id long, text string, lang string")).count() == 0
