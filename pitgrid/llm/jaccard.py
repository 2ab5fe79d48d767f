"""Join of texts whose word shingles have a Jaccard similarity of 0.8 or more.

1. One pass over the texts makes of each its set of hashed 5-word shingles, a digest of the
   set, and the set's rarest fifth under a fixed order.  Texts with one digest are one class;
   only classes go on, so copies cost nothing more.
2. Two sets that reach the similarity share a shingle of that fifth (prefix filter), so the
   shingles that several classes share deal the classes into blocks, losing no pair.
3. A block is joined by a count-vector R-tree: shingles are hashed into groups, a class is
   the point of its group counts, tree nodes carry the largest counts below them, and the
   sum over groups of the smaller of two counts bounds the overlap.  Pairs that survive the
   bounds are verified on the sets, unless links already found make the answer known.
   First every class meets one other, the smallest class of most of its shingles, in blocks
   of that class; this finds most links.  Then the shingles whose classes are still in
   different components are joined as whole blocks, tiled where large, so that no link is
   lost: on the points alone first, and on sets for what then still has a partner, where
   each set goes to one block of all that its partners reach, not to all blocks it was in.

The order puts shingles of frequent hash groups last.  The group counts are a table of fixed
size, and any order gives the same links; it only keeps passages that many texts share from
dealing them all into one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm.components import components
from pitgrid.llm.shingling import digest, mix, shingle_set
from pitgrid.llm.staging import drop, stage

WIDTH = 5
#: The similarity as a fraction.
TOP, BOTTOM = 4, 5
ORDER_GROUPS = 1 << 19
COORDINATES = 256
#: Groups of sets of over so many shingles.
FINER = ((16384, 32768), (1024, 2048))
FANOUT = 16
#: Bits of the filter that finds the texts of candidates: 4 MB.
FILTER_BITS = 1 << 25
#: Numbers in one piece of an array that tasks add up.
PIECE = 1 << 13
#: Classes in one block or tile, besides the class that all tiles share.
TILE = 512


def needed(a, b):
    """The least overlap of sets of sizes ``a`` and ``b`` that are similar enough."""
    return -(-(TOP * (a + b)) // (TOP + BOTTOM))


class CountTree:
    """Points of group counts, packed by size into nodes that keep largest counts and size bounds."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((counts[:, 0], counts[:, 1], sizes)) if len(sizes) else np.empty(0, np.int64)
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = [(self.counts, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            most, low, high = self.levels[-1]
            cut = np.arange(0, len(most), FANOUT)
            self.levels.append((np.maximum.reduceat(most, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def near(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound on the overlap is enough, as positions of the input."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            most, low, high = self.levels[depth]
            at = at[(BOTTOM * high[at] >= TOP * size) & (TOP * low[at] <= BOTTOM * size)]
            bound = np.minimum(most[at], counts).sum(axis=1, dtype=np.int64)
            at = at[bound >= needed(size, np.maximum(low[at], -(-TOP * size // BOTTOM)))]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """The point of a set: counts of hash groups, more of them for larger sets."""
    groups = next((c for most, c in FINER if len(shingles) > most), COORDINATES)
    return np.bincount(((shingles >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint32)


#: Kinds of numbers that a point is kept in, the smallest that holds its counts; the first byte names it.
KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def packed(point: np.ndarray) -> bytes:
    size = next(n for n, kind in KINDS.items() if point.max(initial=0) <= np.iinfo(kind).max)
    return bytes([size]) + point.astype(KINDS[size]).tobytes()


def unpacked(kept: bytes) -> np.ndarray:
    return np.frombuffer(kept, KINDS[kept[0]], offset=1).astype(np.uint32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups; their numbers divide each other."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.uint32) if len(point) > groups else point


def may_reach(one: np.ndarray, two: np.ndarray) -> bool:
    groups = min(len(one), len(two))
    return bool(np.minimum(folded(one, groups), folded(two, groups)).sum(dtype=np.int64) >= needed(int(one.sum(dtype=np.int64)), int(two.sum(dtype=np.int64))))


def bounded_pairs(points: list[np.ndarray], part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each point the later ones of another part whose bound on the overlap is enough.

    The tree holds points of the coarsest kind; pairs that both have finer ones must pass on these too.
    """
    counts = np.stack([folded(x, COORDINATES) for x in points])
    sizes = counts.sum(axis=1, dtype=np.int64)
    tree = CountTree(counts, sizes)
    for i in range(len(sizes)):
        rivals = tree.near(counts[i], int(sizes[i]))
        rivals = rivals[(rivals > i) & (part[rivals] != part[i])]
        if len(points[i]) > COORDINATES and len(rivals):
            rivals = np.array([j for j in rivals.tolist() if may_reach(points[i], points[j])], np.int64)
        yield i, rivals


def block_links(keys: np.ndarray, sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all similar classes of a block; ``labels`` are components known before."""
    sizes = np.array([len(s) for s in sets], np.int64)
    known = {label: i for i, label in enumerate(dict.fromkeys(labels.tolist()))}
    part = np.array([known[x] for x in labels.tolist()], np.int64)
    links = []
    for i, rivals in bounded_pairs([group_counts(s) for s in sets], part):
        for j in rivals:
            if part[j] == part[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if BOTTOM * both >= TOP * (sizes[i] + sizes[j] - both):
                links.append((int(keys[i]), int(keys[j])))
                part[part == part[j]] = part[i]
    return links


def described(docs: DataFrame, order: np.ndarray | None, key: str, text: str) -> DataFrame:
    """For every row: n_shingles, the digest, the rarest fifth of the set, and the point."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(order) if order is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = held.value if held is not None else np.zeros(ORDER_GROUPS, np.int64)
        for batch in batches:
            n, a, b, prefix, points = [], [], [], [], []
            for value in batch.column(1).to_pylist():
                s = shingle_set(value, WIDTH)
                one, two = digest(s)
                n.append(len(s)), a.append(one), b.append(two), points.append(packed(group_counts(s)))
                if len(s):
                    s = s[np.lexsort((s, rank[(s % np.uint64(ORDER_GROUPS)).astype(np.int64)]))]
                    s = s[: len(s) - (-(-TOP * len(s) // BOTTOM)) + 1]
                prefix.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                names=["doc_id", "n_shingles", "a", "b", "prefix", "point"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, a long, b long, prefix array<long>, point binary"
    )


def merged(parts: DataFrame, numbers: int, how) -> np.ndarray:
    """One array of ``numbers`` 64-bit numbers from the pieces (piece, data) of every task, piece by piece.

    The array has a fixed size; its pieces are dealt out, so no task holds more of it than its own pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(data, np.int64)
                own[piece] = how(own[piece], new) if piece in own else new.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["piece", "data"])

    out = np.zeros(numbers, np.int64)
    for piece, data in parts.repartition("piece").mapInArrow(run, "piece long, data binary").collect():
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(data, np.int64)
    return out


def pieces(array: np.ndarray) -> pa.RecordBatch:
    """The pieces of an array that aren't all 0."""
    cut = [(i, array[i * PIECE : (i + 1) * PIECE]) for i in range(len(array) // PIECE)]
    some = [(i, x.tobytes()) for i, x in cut if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["piece", "data"])


def group_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """How many shingles of all texts fall into each of a fixed number of hash groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_GROUPS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (shingle_set(x, WIDTH) % np.uint64(ORDER_GROUPS)).astype(np.int64), 1)
        yield pieces(total)

    return merged(docs.select(F.col(text)).mapInArrow(run, "piece long, data binary"), ORDER_GROUPS, np.add)


def key_bits(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def key_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_BITS // 64, np.int64)
        for batch in batches:
            at = key_bits(batch.column(0).to_numpy())
            np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63))
        yield pieces(words)

    return merged(wanted.mapInArrow(run, "piece long, data binary"), FILTER_BITS // 64, np.bitwise_or).view(np.uint64)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter has, and some that it takes for them."""
    at = key_bits(keys)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def with_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and set, as bytes, of the classes of ``wanted`` and of some others.

    A filter of fixed size lets texts go on at once; the more keys it holds, the more other
    texts pass it, which the join that follows leaves out.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    held = docs.sparkSession.sparkContext.broadcast(key_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bits, batch.column(0).to_numpy())))
            sets = [shingle_set(x, WIDTH).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["key", "set"])

    return texts.mapInArrow(run, "key long, set binary")


def by_block(members: DataFrame, run, schema: str) -> DataFrame:
    """``run`` (columns by name -> rows) over each block of ``members``.

    Blocks are short and many, so a task sorts its rows by block and walks through them; it
    holds one Arrow batch and the block that goes on in the next.
    """
    columns = ["block", *[c for c in members.columns if c != "block"]]
    kinds = pa.schema([pa.field(*(x.split(" ")[0], pa.int64())) for x in schema.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def rows_of(table: pa.Table, whole: bool):
            nonlocal rest
            block = table["block"].to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(block)) + 1, len(block)) if len(block) else np.empty(0, np.int64)
            last = len(cuts) if whole else len(cuts) - 1
            start, out = 0, []
            flat = {c: table[c].to_numpy() for c in columns if not pa.types.is_binary(table[c].type)}
            for end in cuts[:last].tolist():
                if end - start > 1:  # points and sets of one block at a time
                    out += run({c: flat[c][start:end] if c in flat else table[c].slice(start, end - start).to_pylist() for c in columns})
                start = end
            rest = table.slice(start)
            made = list(zip(*out)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], schema=kinds)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield rows_of(pa.concat_tables([rest, table]) if rest is not None else table, False)
        if rest is not None:
            yield rows_of(rest, True)

    return members.select(*columns).repartition("block").sortWithinPartitions("block").mapInArrow(walk, schema)


def joined_blocks(members: DataFrame) -> DataFrame:
    """Links found in each block of ``members`` (block, key, label, set)."""

    def run(cols: dict) -> list[tuple[int, int]]:
        once = sorted({(k, s): x for k, s, x in zip(cols["key"].tolist(), cols["set"], cols["label"].tolist(), strict=True)}.items())
        keys, labels = np.array([k for (k, _), _ in once]), np.array([x for _, x in once])
        return block_links(keys, [np.frombuffer(s, np.uint64) for (_, s), _ in once], labels)

    return by_block(members, run, "a long, b long")


def still_open(members: DataFrame) -> DataFrame:
    """Rows of ``members`` (block, key, label, point) whose bounds leave them a partner of another label.

    ``mate`` is the smallest key of the block that such partners reach, one after the other.
    """

    def run(cols: dict) -> list[tuple[int, int, int, int]]:
        keys, part = cols["key"], cols["label"]
        mate, keep = keys.copy(), np.zeros(len(keys), bool)
        for i, rivals in bounded_pairs([unpacked(x) for x in cols["point"]], part):
            keep[rivals] = True
            keep[i] |= len(rivals) > 0
            if (mate[rivals] != mate[i]).any():
                met = np.isin(mate, np.append(mate[rivals], mate[i]))
                mate[met] = mate[met].min()
        at = np.flatnonzero(keep)
        return list({(int(cols["block"][i]), int(keys[i]), int(part[i]), int(mate[i])) for i in at})

    return by_block(members, run, "block long, key long, label long, mate long")


def gathered(left: DataFrame) -> DataFrame:
    """block, key and label of ``left`` (``still_open``), with each key in few blocks.

    A key's partners lie in many blocks, and its set would go to each.  Keys that partners reach
    from one another meet instead in one block, or in pairs of tiles where these are fewer rows.
    """
    place = components(left.select(F.col("key").alias("a"), F.col("mate").alias("b"))).select(F.col("id").alias("key"), F.col("label").alias("token"))
    own = left.groupBy("key").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("rows")).join(place, "key")
    size = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    few = size.where((F.col("n") <= TILE) | (F.ceil(F.col("n") / (TILE // 2)) * F.col("n") <= F.col("rows"))).select("token")
    met = stage(own.join(few, "token").select("token", "key", "label"), "met")
    anew = tiles(met.select("token", "key")).join(met.select("key", "label"), "key").select("block", "key", "label")
    return anew.unionByName(left.select("block", "key", "label").join(met.select("key"), "key", "left_anti").select("block", "key", "label"))


def within_bounds(pairs: DataFrame) -> DataFrame:
    """key and low of the ``pairs`` (key, low, point, other) whose points allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            keep = [may_reach(unpacked(one), unpacked(two)) for one, two in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("key", "low", "point", "other").mapInArrow(run, "key long, low long")


def tiles(pairs: DataFrame) -> DataFrame:
    """``pairs`` (token, key) with blocks: a token's classes, or pairs of tiles where they are many."""
    many = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    k = F.ceil(F.col("n") / (TILE // 2)).cast("int")
    tiled = pairs.join(many, "token").withColumn("k", F.when(F.col("n") <= TILE, 1).otherwise(k)).withColumn("t", F.pmod(F.xxhash64("key"), F.col("k")))
    other = tiled.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return other.select(F.xxhash64("token", F.least("t", "u"), F.greatest("t", "u")).alias("block"), "key")


DIGESTS = ["a", "b", "n_shingles"]


def first_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """key, prefix and point of every class, of the rows with its smallest id.

    Copies, and rows that a filter of fixed size takes for them, are joined to their classes; what
    the filter doesn't hold is a class's first row and stays where it is.
    """
    own = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", *DIGESTS, "prefix", "point")
    copies = own.select("doc_id", *DIGESTS).join(classes, DIGESTS).where("doc_id != key").select("doc_id")
    held = rows.sparkSession.sparkContext.broadcast(key_filter(copies))

    def part(copied: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_hold(held.value, batch.column(0).to_numpy()) == copied))

        return own.mapInArrow(run, own.schema)

    found = part(True).join(classes, DIGESTS).where("doc_id = key").select(own.columns)
    return part(False).unionByName(found).select(F.col("doc_id").alias("key"), "prefix", "point")


def classed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every row with its digest; the classes; the shingles of prefixes that several classes have; and these classes' points."""
    rows = stage(described(docs, group_frequencies(docs, text), key, text), "sets")
    classes = stage(rows.where("n_shingles > 0").groupBy(*DIGESTS).agg(F.min("doc_id").alias("key")), "classes")
    first = first_rows(rows, classes)
    postings = first.select("key", F.explode("prefix").alias("token")).repartition("token")
    shared = postings.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    held = stage(postings.join(shared, "token").select("token", "key", "low").distinct(), "postings")
    points = stage(first.select("key", "point").join(held.select("key").distinct(), "key", "left_semi"), "points")
    return rows, classes, held, points


def classes_and_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every row with the key of its class, and the links between classes.

    A class's key is its smallest id; an empty set has none.  Links: not all of them, but
    enough to join what they all join.
    """
    rows, classes, held, points = classed(docs, key, text)

    # one partner for each class: the smallest class of most of its shingles
    counted = held.where("key != low").groupBy("key", "low").agg(F.count(F.lit(1)).alias("n"))
    pairs = stage(counted.groupBy("key").agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("low")), "pairs")
    both = pairs.join(points, "key").join(points.select(F.col("key").alias("low"), F.col("point").alias("other")), "low")
    near = stage(within_bounds(both), "near")
    size = near.groupBy("low").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / TILE))
    dealt = near.join(size, "low").select("low", "key", part.alias("t"))
    block = F.xxhash64("low", "t").alias("block")
    members = stage(dealt.select(block, "key").union(dealt.select(block, F.col("low")).distinct()), "blocks")
    sets = stage(with_sets(docs, members.select("key").distinct(), key, text), "candidates")
    links = stage(joined_blocks(members.join(sets, "key").withColumn("label", F.col("key"))), "links")
    drop(near, members, sets)

    labels = components(links)
    labelled = held.join(labels.withColumnRenamed("id", "key"), "key", "left").select("token", "key", F.coalesce("label", "key").alias("label"))
    open_ = labelled.groupBy("token").agg(
        F.min("label").alias("la"), F.max("label").alias("lb"), F.min("key").alias("low"), F.max("key").alias("key"), F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("key"), F.lit(1 << 40))).alias("who"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("which"),
    ).where("la < lb")
    # tokens with the same classes make the same block, so one stands for all of them; two
    # classes that have met need not meet again
    one = open_.groupBy("n", "low", "key", "who", "which").agg(F.min("token").alias("token"))
    met = pairs.withColumn("n", F.lit(2).cast("long"))
    one = one.join(met, ["n", "low", "key"], "left_anti").select("token")
    rest = stage(labelled.join(one, "token"), "open")
    drop(held, pairs, links)
    known = rest.select("key", "label").distinct().join(points, "key")
    left = stage(still_open(tiles(rest.select("token", "key")).join(known, "key")), "left")
    drop(rest, points)
    sets = stage(with_sets(docs, left.select("key").distinct(), key, text), "candidates")
    more = stage(joined_blocks(gathered(left).join(sets, "key")), "links")
    drop(left, sets)
    return rows.join(classes, DIGESTS, "left").drop("prefix", "point"), labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more)


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, class_id) of every row, and all links (a, b) between classes, a < b.

    Rows with equal sets are one class, named by its smallest id; copies aren't expanded into
    pairs.  No link is skipped here, so the pairs of a group of near copies are as many as
    the group's links.
    """
    rows, classes, held, points = classed(docs, key, text)

    def close(cols: dict) -> list[tuple[int, int]]:
        keys = cols["key"]
        found = bounded_pairs([unpacked(x) for x in cols["point"]], keys)
        return list({(int(min(keys[i], keys[j])), int(max(keys[i], keys[j]))) for i, rivals in found for j in rivals.tolist()})

    pairs = stage(by_block(tiles(held.select("token", "key")).join(points, "key"), close, "a long, b long").distinct(), "pairs")
    sets = stage(with_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), key, text), "candidates").dropDuplicates(["key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(BOTTOM * both >= TOP * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("two")), "b")
    links = stage(both.select("a", "b", "one", "two").mapInArrow(verify, "a long, b long"), "links")
    return rows.join(classes, DIGESTS, "left").select("doc_id", "n_shingles", F.coalesce("key", "doc_id").alias("class_id")), links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    component_id is the smallest id that links of similarity 0.8 or more reach.  A null text,
    or one without words, has an empty set and is its own component.  Rows repeated under one
    id are each returned and each judged by their own text, but classes with the same smallest
    id count as linked; a row with a null id gets its component's smallest id, or null; other
    columns aren't read.
    """
    rows, links = classes_and_links(docs, key, text)
    labels = components(links).select(F.col("id").alias("key"), "label")
    return rows.join(labels, "key", "left").select("doc_id", "n_shingles", F.coalesce("label", "key", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose id isn't their component's smallest; columns as they are."""
    gone = near_duplicates(docs, key, text).where("doc_id != component_id").select(F.col("doc_id").alias("__pitgrid_gone")).distinct()
    return docs.join(gone, docs[key].cast("long") == gone["__pitgrid_gone"], "left_anti")
