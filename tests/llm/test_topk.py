import numpy as np

from pitgrid.llm import topk


def brute(rows, k, every):
    ok = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in ok.items():
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok.items() if i != q and len(b) == len(a) and a)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def made(n=400, dims=16):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, dims).astype("f4")]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(20)]
    rows += [(n + 50, None), (n + 51, [None] * dims), (n + 52, [float("nan")] * dims), (n + 53, [float("inf")] + [0.0] * (dims - 1)), (n + 54, []), (n + 55, [0.0] * dims), (n + 56, [1.0, 2.0]), (n + 60, [1.0, -2.0])]
    return rows


def test_matches_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:9]], "vec_id long, embedding array<float>, score int")
    for shard_rows in (50, 10_000):
        got = topk.search(df, k=5, every=10, shard_rows=shard_rows).collect()
        assert {tuple(r) for r in got} == brute(rows, 5, 10) and len(got) == len(brute(rows, 5, 10))


def test_empty(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.search(spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_large_values_and_null_keys(spark):
    rng = np.random.default_rng(4)
    top = (1 << 63) - 1
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3) * (1e9 if i % 2 else 1e16)]) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (40, [1e300, -1e300, 0.0])]
    cut = lambda x: max(-top - 1, min(top, x))
    ints = {i: [cut(int(np.floor(x * 256))) for x in v] for i, v in rows if i is not None}
    want = set()
    for q in (0, 10, 20, 30, 40):
        found = sorted((-cut(sum(x * y for x, y in zip(ints[q], v))), i) for i, v in ints.items() if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.search(df, k=5, every=10).collect()} == want


def test_many_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(300)] + [(300 + i, [-1.0, 0.25 * i]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 5, 400):
        assert {tuple(r) for r in topk.search(df, k=k, every=100, shard_rows=64).collect()} == brute(rows, k, 100)
