import random
import zlib

import numpy as np
import pytest

from pitgrid.llm import packing

TEXTS = [None, "", " ", "one", "a  b   c \n d ", "x <|endoftext|> y", "word " * 3000, "z" * 9000, "\t　 é　 b \x85", *[f"number {i} " * (i % 40) for i in range(400)]]


def packed(spark, texts):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "s", 1) for i, t in enumerate(texts)] + [(1, "", "s", 1)], "doc_id long, text string, sequence_id string, size int")
    return docs, packing.pack(docs).toPandas()


@pytest.mark.parametrize("leaf", [8, 64, packing.LEAF])
def test_pieces_and_places(spark, monkeypatch, leaf):
    monkeypatch.setattr(packing, "LEAF", leaf)
    docs, got = packed(spark, TEXTS)
    assert got.columns.tolist() == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_path())
    want = []
    for r in docs.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [2]
        count = -(-len(ids) // 1024)
        stops = [0] + [len(ids) - 1024 * k for k in range(count - 1, -1, -1)]
        want += [(str(r.doc_id), k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(stops, stops[1:]))]
    rows = [("None" if r.doc_id != r.doc_id else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    least = -(-got.length.sum() // 1024)
    assert got.sequence_id.nunique() <= least + (1 if leaf > 64 else 3)


def test_residues_from_leaves_fill_each_other(spark, monkeypatch):
    # sevens of 512 tokens in leaves of one piece: only the tree can join them
    monkeypatch.setattr(packing, "LEAF", 1)
    docs = spark.createDataFrame([(i, " a" * 511) for i in range(64)], "doc_id long, text string")
    assert packing.pack(docs).select("sequence_id").distinct().count() == 32


def test_best_fit_against_plain():
    random.seed(1)
    for limit in (10, 100, 1024):
        sizes = np.array([random.randint(1, limit) for _ in range(300)])
        bins, offsets, fills = packing.best_fit(sizes, limit)
        plain = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [f for f in plain if f + s <= limit]
            if fit:
                plain.remove(max(fit))
                plain.append(max(fit) + s)
            else:
                plain.append(s)
        assert sorted(plain) == sorted(fills.tolist())
        assert sum(2 * f <= limit for f in fills) <= 1
        for b in range(len(fills)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (np.cumsum(sizes[own]) - sizes[own] == offsets[own]).all() and sizes[own].sum() == fills[b]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
