import random
import re

from pitgrid.llm import jaccard
from pitgrid.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    got = [(i, sets(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(got):
        for j, b in got[:n]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in got}


def made():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice((3, 5, 7, 30, 90, 200)))]
        base += shared if rng.random() < 0.4 else []
        for _ in range(rng.choice((1, 1, 2, 5))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper())
    rng.shuffle(rows)
    return [(10 + i, t) for i, t in enumerate([*rows, None, "", " \t", "One", "one ", "two", "a b c d", "A b C d"])]


def test_matches_brute_force(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, key string, component_id int")
    want = brute(rows)
    for tile in (512, 4):
        monkeypatch.setattr(jaccard, "TILE", tile)
        got = jaccard.near_duplicates(df).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(rows)
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {i for i, _, c in want if i == c}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.near_duplicates(df).collect()) == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 3)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


def test_all_links_between_classes(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    membership, links = jaccard.similar_pairs(df)
    smallest = {}
    for i, t in rows:
        smallest.setdefault(frozenset(sets(t)) or i, i)
    assert {(r.doc_id, r.class_id) for r in membership.collect()} == {(i, smallest[frozenset(sets(t)) or i]) for i, t in rows}
    ones = [(i, sets(t)) for i, t in rows if sets(t) and smallest[frozenset(sets(t))] == i]
    want = {(i, j) for i, a in ones for j, b in ones if i < j and 100 * len(a & b) >= 80 * len(a | b)}
    assert want and sorted(tuple(r) for r in links.collect()) == sorted(want)


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i % 7919}x{i}" for i in range(20000))
    rows = [(1, long), (2, long + " tail"), (3, "other " * 3000), (4, None)]
    df = spark.createDataFrame([(*r, 9, b"x", "y", 0) for r in rows], "doc_id long, text string, label int, set binary, point string, block int")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert jaccard.keep_one(df).columns == df.columns


def test_only_copies_are_shuffled_with_their_shingles(spark):
    texts = [(5, "a b c d e f"), (3, "a b c d e f"), (4, "g h i j k l"), (4, "a b c d e f"), (None, "m n o p q r"), (7, ""), (8, None), (9, "m n o p q s"), (9, "m n o p q s")]
    rows = jaccard.described(spark.createDataFrame(texts, "doc_id long, text string"), None, "doc_id", "text").cache()
    classes = rows.where("n_shingles > 0").groupBy(*jaccard.DIGESTS).agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "key")
    want = rows.join(classes, jaccard.DIGESTS).where("doc_id = key").select("key", "prefix", "point")
    got = jaccard.first_rows(rows, classes)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.index("MapInArrow") < plan.index("Join")
    rows.unpersist()


def test_a_set_goes_to_one_block_of_all_that_its_partners_reach(spark, monkeypatch):
    # three classes that share many blocks, and a pair apart
    rows = [(b, k, k, 1) for b in range(20) for k in (1, 2, 3)] + [(b, k, k, 8) for b in (30, 31) for k in (8, 9)]
    left = spark.createDataFrame(rows, "block long, key long, label long, mate long")
    got = jaccard.gathered(left).collect()
    assert sorted((r.key, r.label) for r in got) == [(k, k) for k in (1, 2, 3, 8, 9)]
    assert sorted(sorted(r.key for r in got if r.block == b) for b in {r.block for r in got}) == [[1, 2, 3], [8, 9]]
    # more than a tile, and fewer rows as they are: nothing moves
    monkeypatch.setattr(jaccard, "TILE", 2)
    chain = spark.createDataFrame([(b, k, k, 1) for b, ks in ((1, (1, 2)), (2, (1, 3)), (3, (1, 4)), (4, (1, 5))) for k in ks], "block long, key long, label long, mate long")
    assert sorted((r.block, r.key) for r in jaccard.gathered(chain).collect()) == sorted((r.block, r.key) for r in chain.collect())
