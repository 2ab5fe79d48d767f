import zlib

import numpy as np
from pyspark.sql import functions as F

from pitgrid.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.96 and 0 <= got[1] and got[2] <= 1


def test_defined_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").limit(200)
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !!", "fr"), (None, "the of and", None), (-4, "der und die " * 20_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.union(odd).union(odd).withColumn("score", F.lit("x"))).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    assert got[-4].lang_pred == "de" and not got[None].held_out
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.where("doc_id < -1")).collect()} <= {"und", "fr"}


def test_pairs_of_a_family_vote(monkeypatch):
    """Of four languages in a row the inner ones can be told from each other one, but not from all others at once."""
    place = {"es": 0, "fr": 1, "it": 2, "pt": 3}
    point = lambda k, j: np.array([k - 1.5 + 0.1 * j, 0.1 * j], np.float32)
    model = langid.learn([(lang, point(k, j)) for lang, k in place.items() for j in (-2, -1, 0, 1, 2)])
    assert len(model.within["romance"]) == 6
    monkeypatch.setattr(langid, "features", lambda text: point(place[text], 0))
    got = {lang: model.predict(lang) for lang in place}
    assert all(lang == p[0] and 0 < p[1] <= 1 for lang, p in got.items()), got


def test_numerals_are_no_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "½ ² ①", "en"), (-2, "½ the", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.union(odd)).where("doc_id < 0").collect()}
    assert got[-1] == "und" and got[-2] != "und"


def brute_force(rows, texts):
    """The two steps with explicit loops over families and pairs."""
    from itertools import combinations

    langs = sorted({lang for lang, _ in rows})
    fams = sorted({langid.family(x) for x in langs})
    x = np.stack([f for _, f in rows])
    machine = lambda keep, yes: langid.svm(x[keep], np.where(np.array(yes)[keep], 1.0, -1.0))
    every = np.ones(len(rows), bool)
    top = {f: machine(every, [langid.family(lang) == f for lang, _ in rows]) for f in fams}
    duel = {(a, b): machine(np.array([lang in (a, b) for lang, _ in rows]), [lang == a for lang, _ in rows]) for f in fams for a, b in combinations([y for y in langs if langid.family(y) == f], 2)}
    out = []
    for t in texts:
        v = langid.features(t)
        if v is None:
            out.append("und")
            continue
        fam = max(fams, key=lambda f: top[f][:-1] @ v + top[f][-1]) if len(fams) > 1 else fams[0]
        own = [y for y in langs if langid.family(y) == fam]
        won, margin = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for (a, b), w in duel.items():
            if a in own:
                m = float(w[:-1] @ v + w[-1])
                won[a if m > 0 else b] += 1
                margin[a] += m
                margin[b] -= m
        out.append(max(own, key=lambda y: (won[y], margin[y])))
    return out


def test_against_brute_force(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null").collect()]
    spread = {"en": ("en", "de", "nl"), "fr": ("fr", "es")}
    rows = [(spread.get(lang, (lang,))[i % len(spread.get(lang, (lang,)))], f) for i, (t, lang) in enumerate(docs[:120]) if (f := langid.features(t)) is not None]
    model = langid.learn(rows)
    texts = [t for t, _ in docs[120:]] + ["", "12 ½", None]
    assert [model.predict(t)[0] for t in texts] == brute_force(rows, [t or "" for t in texts])
