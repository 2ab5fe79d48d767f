import random

from pitgrid.llm import tokencount

TEXTS = [None, "", "  ", "it's 'll DON'T étéжabc a²3 x<|endoftext|>y", "word " * 5000, "z" * 30_000, "\n\n a　　b \x1c!\x1c x\x85\x85y", "(hello),### word-word_word 12ab3"]


def test_matches_whole_texts(spark):
    random.seed(4)
    texts = TEXTS + ["".join(random.choice("ab1!'tsre \n　\xa0\x1céж²́<|endoftext|>​") for _ in range(80)) for _ in range(3000)]
    got = tokencount.count_tokens(spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens string")).collect()
    whole = tokencount.UnitCounts(tokencount.default_path()).tokenizer
    assert len(got) == 2 * len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(whole.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024), text[:90]


def test_empty(spark):
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
