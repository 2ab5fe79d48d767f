import hashlib
import random
from collections import Counter

from pitgrid.llm import alignment

ODD = [None, "", " ", "  ", "a", "\n", "▁x y", "<0x41> <|endoftext|> z", "a  b   c \n d", "é日本 😀 \x00 ́", "\t x \x1c y　 z\x85 w", "<s> </s> <unk>", "x" * 300, "the same words " * 900]


def plain(docs):
    """Every document on its own, by whole encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    left, right = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    left.encode_special_tokens = True
    values = alignment.byte_values()
    piece = lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode()
    rows, links, counts = {}, {}, Counter()
    for key, text in docs:
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        sides = [bytes(values[c] for c in left.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            rows[key], links[key] = (0, 0, 0, 0, ""), []
            continue
        ends = []
        for s in sides:
            at, upto = {}, 0
            for n, x in enumerate(s):
                upto += len(x)
                at[upto] = n + 1
            ends.append(at)
        told, own, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            told.append(",".join(map(str, a[i : ends[0][e]])) + "|" + ",".join(map(str, b[j : ends[1][e]])))
            i, j = ends[0][e], ends[1][e]
            own.append((a[i - 1], b[j - 1]))
        counts.update(own)
        rows[key], links[key] = (len(a), len(b), len(told), len(own), hashlib.sha256(";".join(told).encode()).hexdigest()), own
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return {k: (*v, sum(counts[x] == top[x[1]] for x in links[k]), sum(counts[x] for x in links[k])) for k, v in rows.items()}


def test_against_whole_encodings(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 3000)
    random.seed(3)
    texts = ODD + ["".join(random.choice("ab1!'tsre \n　\xa0\x1céж²́▁<|endoftext|>") for _ in range(60)) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    docs = list(enumerate(texts))
    got = alignment.align(spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, block string, n_a int").repartition(3)).collect()
    want = plain(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == want[r.doc_id], docs[r.doc_id]
        assert max(r.n_a, r.n_b) <= r.n_overlaps <= r.n_a + r.n_b - r.n_groups or r.n_a == 0


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = alignment.align(spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one")], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert {r.count_sum for r in rows if r.doc_id == 1} == {3 + 2}
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_a == 0
