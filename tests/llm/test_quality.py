import re
from collections import Counter

from pitgrid.llm import quality

TEXTS = [None, "", "a b c", "one two three four five", "a b c d e " * 8, "x\n\nx\nX \n x\n" + "word " * 30,
         "It is a calm day. We walk by the sea, and talk about many things. " * 1 + "Then some other words follow here. " * 2,
         "¤# $% &&& ** || <> " * 9, "é" * 500 + " z", "q w e r t y u i o p a s d f q w e r t z x c v", "w " * 20_000,
         " ".join(f"w{i % 977}x{i}" for i in range(30_000))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    again = len({p for i, g in enumerate(grams) if often[g] > 1 for p in range(i, i + 5)})
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n)


def rows(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_words int")


def test_counts_match_brute_force(spark):
    got = quality.judge(rows(spark)).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_stage_keeps_rows_as_they_are(spark):
    kept = {r.doc_id for r in quality.judge(rows(spark)).where("kept").collect()}
    out = quality.keep_good(rows(spark))
    assert out.columns == ["doc_id", "text", "n_words"] and {r.doc_id for r in out.collect()} == kept
    assert all(r.n_words == 7 for r in out.collect())


def test_empty_table(spark):
    assert quality.judge(rows(spark).limit(0)).count() == 0
    assert quality.keep_good(rows(spark).limit(0)).count() == 0


def test_labels_agree(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judge(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n[1, True] > 30 * n.get((1, False), 0) and n[0, False] > n.get((0, True), 0), n
