"""Scores of texts under a Katz backoff bigram model of the corpus itself.

The model: counts of words and of pairs of words from the training documents; counts up to
``LOW`` are discounted by Good-Turing (Katz's form); what the discounts free goes to the words
not seen after a word, by their own probability, with a backoff weight that makes each
distribution add up to one exactly.  The probability of a token is found recursively: the
pair's if the table has it, else the weight of the word before times the token's own, else
the share of unseen words.  The table has the pairs with a count of ``least`` or more: 1, as
the query asks for, keeps all of them; 2 leaves pairs seen once to backoff.

The work is dealt twice.  *Shards* are groups of documents of about equal bytes: a shard's
task makes the sorted distinct words and pairs of its own texts.  *Buckets* divide the word
and pair tables by hash: a bucket's task adds up what the shards send, and sends each shard
back what it asked about, in the order of the question.  Questions, answers and texts travel
as compressed arrays, one row per shard and bucket, so a pair that a shard holds a thousand
times travels once, and no word or pair, however frequent, makes one task larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pitgrid.llm.shingling import spans
from pitgrid.llm.staging import stage

SHARD_BYTES = 12 << 20
LOW = 5
#: Stands for the end token among the hashes of words.
END = np.uint64(1)
WORDS, PAIRS = 0, 1


def packed(x: np.ndarray) -> bytes:
    """An array of 1-dimensional numbers, its bytes ordered by significance, compressed."""
    import zstandard

    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    import zstandard

    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return raw.reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def deltas(x: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers, as differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def summed(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unpacked(b, kind), dtype=kind)


class Texts:
    """The tokens of a shard's texts: word ranks in the shard's sorted words, in order."""

    def __init__(self, ids: list, held: list[bool], texts: list[str]):
        self.ids, self.held = ids, np.array(held, bool)
        runs = [np.append(spans(t, 1), END) for t in texts]
        self.sizes = np.array([len(r) for r in runs], np.int64)
        every = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        self.words, self.rank = np.unique(every, return_inverse=True)
        self.of = np.repeat(np.arange(len(runs)), self.sizes)
        self.training = ~self.held[self.of] if len(runs) else np.empty(0, bool)
        self.first = np.zeros(len(every), bool)
        self.first[np.cumsum(self.sizes)[:-1]] = True
        if len(every):
            self.first[0] = True

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.rank[self.training], minlength=len(self.words))

    def pairs(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's (number of the word before, own number) as one 64-bit key; the word before the first is 0."""
        own = number[self.rank].astype(np.uint64)
        before = np.zeros_like(own)
        before[1:] = own[:-1]
        before[self.first] = 0
        return (before << np.uint64(32)) | own, own


def shard_texts(docs: DataFrame, shards: int, key: str, text: str, held: Column) -> DataFrame:
    """One row per shard and Arrow batch with the texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import zstandard

        for batch in batches:
            groups: dict[int, list] = {}
            for s, i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups.setdefault(s, []).append((i, h, t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups.keys(), pa.int32()), pa.array([zstandard.ZstdCompressor(level=3).compress(pickle.dumps(g)) for g in groups.values()], pa.binary())],
                names=["shard", "texts"],
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    shard = F.pmod(F.xxhash64(F.col(key), F.substring(whole, 1, 64)), F.lit(shards)).cast("int")
    return docs.select(shard.alias("shard"), F.col(key).alias("id"), held.alias("held"), whole.alias("text")).mapInArrow(run, "shard int, texts binary")


def opened(table: pa.Table) -> Texts:
    import pickle

    import zstandard

    rows = [r for b in table["texts"].to_pylist() for r in pickle.loads(zstandard.ZstdDecompressor().decompress(b))]
    return Texts([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def table_of(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), cols, strict=True)})


WORD_QUESTION = {"bucket": pa.int32(), "shard": pa.int32(), "words": pa.binary(), "counts": pa.binary()}
WORD_ANSWER = {"shard": pa.int32(), "bucket": pa.int32(), "numbers": pa.binary(), "counts": pa.binary(), "stats": pa.list_(pa.int64())}
PAIR_QUESTION = {"bucket": pa.int32(), "shard": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "word_counts": pa.binary()}
PAIR_ANSWER = {"shard": pa.int32(), "bucket": pa.int32(), "counts": pa.binary(), "sums": pa.binary(), "stats": pa.list_(pa.int64())}
DDL = {pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {DDL[v]}" for k, v in kinds.items())


def counts_of_counts(c: np.ndarray) -> list[int]:
    """How many have a count of 0, 1, ..., LOW + 1."""
    return np.bincount(np.minimum(c, LOW + 2).astype(np.int64), minlength=LOW + 3)[: LOW + 2].tolist()


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words % np.uint64(buckets)).astype(np.int64)


def ask_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        shard, t = table["shard"][0].as_py(), opened(table)
        counts, bucket = t.word_counts(), word_bucket(t.words, buckets)
        rows = []
        for b in range(buckets):
            at = np.flatnonzero(bucket == b)
            if len(at):
                rows.append((b, shard, deltas(t.words[at]), packed(counts[at].astype(np.uint32))))
        return table_of(WORD_QUESTION, rows)

    return run


def answer_words(buckets: int):
    """Numbers words by falling count, so that frequent words have small numbers; 0 stays free."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        asked = [summed(b, np.uint64) for b in table["words"].to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        sent = np.concatenate([unpacked(b, np.uint32) for b in table["counts"].to_pylist()])
        counts = np.bincount(at, weights=sent, minlength=len(words)).astype(np.uint64)
        if len(words) * buckets >= 1 << 32:
            raise OverflowError("more than 2**32 distinct words: their numbers need more bits")
        number = np.empty(len(words), np.uint32)
        number[np.lexsort((words, ~counts))] = np.arange(len(words), dtype=np.uint32) * np.uint32(buckets) + np.uint32(bucket + 1)
        stats = [*counts_of_counts(counts), int((counts > 0).sum()), int(counts.sum())]
        rows, start = [], 0
        for shard, a in zip(table["shard"].to_pylist(), asked, strict=True):
            own = at[start : start + len(a)]
            start += len(a)
            rows.append((shard, bucket, packed(number[own]), packed(counts[own]), stats if not rows else None))
        return table_of(WORD_ANSWER, rows)

    return run


def known_words(t: Texts, table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The number and the training count of each of the shard's words, from the answers."""
    number, count = np.zeros(len(t.words), np.uint32), np.zeros(len(t.words), np.uint64)
    bucket = word_bucket(t.words, buckets)
    for b, n, c in zip(table["bucket"].to_pylist(), table["numbers"].to_pylist(), table["counts"].to_pylist(), strict=True):
        at = np.flatnonzero(bucket == b)
        number[at], count[at] = unpacked(n, np.uint32), unpacked(c, np.uint64)
    return number, count


def pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs with one first word share a bucket; numbers of words end in the bucket of their hash, so mix."""
    return (((keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def asked_pairs(t: Texts, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's distinct pairs, sorted, and each token's place among them."""
    return np.unique(t.pairs(number)[0], return_inverse=True)


def ask_pairs(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table_of(PAIR_QUESTION, [])
        shard, t = left["shard"][0].as_py(), opened(left)
        number, count = known_words(t, right, buckets)
        keys, at = asked_pairs(t, number)
        counts = np.bincount(at[t.training], minlength=len(keys)).astype(np.uint32)
        word_counts = np.zeros(len(keys), np.uint64)
        word_counts[at] = count[t.rank]
        bucket, rows = pair_bucket(keys, buckets), []
        for b in range(buckets):
            own = np.flatnonzero(bucket == b)
            if len(own):
                rows.append((b, shard, deltas(keys[own]), packed(counts[own]), packed(word_counts[own])))
        return table_of(PAIR_QUESTION, rows)

    return run


def first_words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct first words of sorted pairs and where each pair's is."""
    return np.unique(keys >> np.uint64(32), return_inverse=True)


def answer_pairs(least: int):
    """To each shard: the counts of its pairs, and for its first words what backoff needs.

    That is, of the pairs of a first word that the table keeps (count of ``least`` or more): how
    many have each low count and the sum of the others, and the same of their second words'
    own counts.  ``SUMS`` columns per first word; also the first word's total.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        asked = [summed(b, np.uint64) for b in table["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        sent = np.concatenate([unpacked(b, np.uint32) for b in table["counts"].to_pylist()])
        counts = np.bincount(at, weights=sent, minlength=len(keys)).astype(np.uint64)
        second = np.zeros(len(keys), np.uint64)
        second[at] = np.concatenate([unpacked(b, np.uint64) for b in table["word_counts"].to_pylist()])
        heads, head = first_words(keys)
        sums = np.zeros((len(heads), 2 * (LOW + 1) + 1), np.int64)
        np.add.at(sums[:, -1], head, counts.astype(np.int64))
        kept = counts >= least
        for offset, c in ((0, counts), (LOW + 1, second)):
            low = kept & (c <= LOW)
            np.add.at(sums, (head[low], offset + c[low].astype(np.int64) - 1), 1)
            high = kept & (c > LOW)
            np.add.at(sums[:, offset + LOW], head[high], c[high].astype(np.int64))
        stats = counts_of_counts(counts)
        rows, start = [], 0
        for shard, a in zip(table["shard"].to_pylist(), asked, strict=True):
            own = at[start : start + len(a)]
            start += len(a)
            mine = np.unique(head[own])
            rows.append((shard, bucket, packed(counts[own]), packed(np.ascontiguousarray(sums[mine]).ravel()), stats if not rows else None))
        return table_of(PAIR_ANSWER, rows)

    return run


def discounts(n: list[int], least: int) -> np.ndarray:
    """Katz's factor for counts 0..LOW, from the numbers of counts 1..LOW+1; 1 where they don't give one.

    ``least`` is the lowest count that the table keeps: lower ones are all given to backoff.
    """
    d = np.ones(LOW + 1)
    if n[1]:
        share = (LOW + 1) * n[LOW + 1] / n[1]
        for r in range(1, LOW + 1):
            if n[r] and share < 1:
                made = ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share)
                d[r] = made if 0 < made < 1 else 1.0
    d[:least] = 0
    return d


class Model:
    """Probabilities from counts; ``words`` and ``pairs`` are sums of the buckets' statistics."""

    def __init__(self, words: list[int], pairs: list[int], least: int):
        self.types, self.total, self.least = words[-2], words[-1], least
        self.d1, self.d2 = discounts(words[: LOW + 2], 1), discounts(pairs[: LOW + 2], least)
        low = sum(self.d1[r] * r * words[r] for r in range(1, LOW + 1))
        high = self.total - sum(r * words[r] for r in range(1, LOW + 1))
        self.unseen = 1 - (low + high) / self.total if self.total else 1.0
        if self.total and self.unseen <= 1e-12:  # nothing was discounted: one more count for the unseen
            self.scale, self.unseen = self.total / (self.total + 1), 1 / (self.total + 1)
        else:
            self.scale = 1.0

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with counts ``c``; unseen words share one."""
        if not self.total:
            return np.ones(len(c))
        c = c.astype(np.float64)
        factor = np.where(c <= LOW, self.d1[np.minimum(c, LOW).astype(int)], 1.0)
        return np.where(c > 0, self.scale * factor * c / self.total, self.unseen)

    def backoff(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and total count of each first word, of the rows of ``sums``.

        Where the discounts free nothing, the total is one more and that one goes to backoff.
        """
        r = np.arange(1, LOW + 1)
        total = np.maximum(sums[:, -1], 1)
        pairs = (sums[:, :LOW] @ (self.d2[1:] * r) + sums[:, LOW]) / total
        words = (sums[:, LOW + 1 : 2 * LOW + 1] @ (self.d1[1:] * r) + sums[:, 2 * LOW + 1]) * self.scale / max(self.total, 1)
        has = sums[:, : LOW + 1].sum(axis=1) > 0
        full = pairs > 1 - 1e-9
        free = np.where(full, 1 / (total + 1), 1 - pairs)
        return np.where(has, free / np.maximum(1 - words, 1e-300), 1.0), total + full

    def pair(self, c: np.ndarray, total: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        factor = np.where(c <= LOW, self.d2[np.minimum(c, LOW).astype(int)], 1.0)
        return np.where(c >= self.least, factor * c / np.maximum(total, 1), weight * own)


SCORES = {"held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def score_texts(model: Model, buckets: int, id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"doc_id": id_type} | SCORES
        if not left.num_rows:
            return table_of(kinds, [])
        t = opened(left)
        what = right["what"].to_pylist()
        number, count = known_words(t, right.filter(pa.array([w == WORDS for w in what])), buckets)
        answers = right.filter(pa.array([w == PAIRS for w in what]))
        keys, at = asked_pairs(t, number)
        bucket = pair_bucket(keys, buckets)
        pair_counts = np.zeros(len(keys), np.uint64)
        weight, total = np.ones(len(keys)), np.zeros(len(keys))
        for b, c, sums in zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), answers["sums"].to_pylist(), strict=True):
            own = np.flatnonzero(bucket == b)
            pair_counts[own] = unpacked(c, np.uint64)
            rows = unpacked(sums, np.int64).reshape(-1, 2 * (LOW + 1) + 1)
            head = first_words(keys[own])[1]
            w, n = model.backoff(rows)
            weight[own], total[own] = w[head], n[head]
        own = model.word(count)
        chance = model.pair(pair_counts[at], total[at], weight[at], own[t.rank])
        add = lambda x: np.bincount(t.of, weights=x, minlength=len(t.ids))
        seen = count[t.rank]
        base = np.log10((seen.astype(np.float64) + 1) / (model.total + model.types + 1))
        return pa.table(
            {
                "doc_id": pa.array(t.ids, id_type), "held_out": pa.array(t.held), "n_tokens": pa.array(t.sizes),
                "n_known": pa.array(add(seen > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(t.ids), model.total, np.int64)),
                "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(chance))),
            }
        )

    return run


def added(df: DataFrame, width: int) -> list[int]:
    row = df.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(width)]).first()
    return [int(x or 0) for x in row]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 2, folds: int = 7, shard_bytes: int = SHARD_BYTES, least: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from the rows whose crc32 of the key modulo ``folds`` isn't ``fold``; a null key is
    learnt from.  A null text is empty and has the end token alone.  Repeated rows give
    repeated rows, each counted.  Other columns aren't read.  Pairs that training has fewer than
    ``least`` times are scored by backoff.
    """
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = buckets = max(1, math.ceil(size / shard_bytes))
    texts = shard_texts(docs, shards, key, text, held)
    asked = texts.groupBy("shard").applyInArrow(ask_words(buckets), ddl(WORD_QUESTION))
    words = stage(asked.groupBy("bucket").applyInArrow(answer_words(buckets), ddl(WORD_ANSWER)), "words")
    asked = texts.groupBy("shard").cogroup(words.drop("stats").groupBy("shard")).applyInArrow(ask_pairs(buckets), ddl(PAIR_QUESTION))
    pairs = stage(asked.groupBy("bucket").applyInArrow(answer_pairs(least), ddl(PAIR_ANSWER)), "pairs")
    model = Model(added(words, LOW + 4), added(pairs, LOW + 2), least)
    both = words.select("shard", "bucket", "numbers", "counts", F.lit(None).cast("binary").alias("sums"), F.lit(WORDS).alias("what")).unionByName(
        pairs.select("shard", "bucket", F.lit(None).cast("binary").alias("numbers"), "counts", "sums", F.lit(PAIRS).alias("what"))
    )
    kind = docs.schema[key].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[key].dataType)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(score_texts(model, buckets, id_type), out)
