"""Alignment of two tokenizers' tokens over whole texts, with counts of aligned ids over the corpus.

The tokens of a block of texts lie on one line of bytes: offsets run on from text to text, so an
offset tells the document as well and the nearest start never belongs to another one.  There
``pandas.merge_asof`` finds for the start of every token the token of the other side that covers
it, in both directions; the union of both holds every pair of tokens that overlap, since of two
such tokens the one that starts later starts inside the other.  Overlapping pairs that end
together are links, and cut the text into groups.

Counts of linked ids are summed in a block before they are shuffled, and come back to each block
for the pairs that it has: what moves grows with the input, and no task holds all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.llm import stretches
from pitgrid.llm.staging import stage

#: Code points of a block of texts; a longer text is a block of its own.
BLOCK = 2_000_000
MARK = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_values() -> dict[str, int]:
    """The byte that a character of a byte-level entry stands for: printable ones themselves, others moved up from 256 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the stretches that a worker knows."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        left = stretches.ByteBpe(a, True)
        values = byte_values()
        names = [left.tokenizer.id_to_token(i) or "" for i in range(left.tokenizer.get_vocab_size())]
        self.left = [bytes(map(values.__getitem__, x)) if all(c in values for c in x) else x.encode() for x in names]
        right = sentencepiece.SentencePieceProcessor(model_file=b)
        ids = range(right.get_piece_size())
        self.right = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.size = [np.array([len(x) for x in side], np.int64) for side in (self.left, self.right)]
        self.bad: set[str] = set()
        # of each id, how it is written before another id of its side, at the end of its side of a group, of a group, and of a text
        self.told = [b"%d%s" % (i, s) for i in range(max(len(self.left), len(self.right))) for s in (b",", b"|", b";", b"")]

        def by_left(texts: list[str]) -> list[bytes]:
            return [self.sound(t, np.frombuffer(ids, np.int32).tolist(), self.left) for t, ids in zip(texts, left(texts))]

        def by_right(texts: list[str]) -> list[bytes]:
            # the model puts the space before a text itself, but not before an empty one
            space = [right.piece_to_id(MARK)]
            return [self.sound(t, ids or space, self.right) for t, ids in zip(texts, right.encode([t[1:] for t in texts], num_threads=1))]

        self.known = stretches.StretchTable(by_left, by_right)

    def sound(self, text: str, ids: list[int], entries: list[bytes]) -> bytes:
        """``ids``, after a look at whether their bytes are those of the stretch."""
        if b"".join([entries[i] for i in ids]) != text.encode("utf-8", "surrogatepass"):
            self.bad.add(text[1:])
        return np.array(ids, np.int32).tobytes()

    def align(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], list[np.ndarray], np.ndarray, np.ndarray]:
        """Counts and digest of each text, the numbers of its linked id pairs in the block's list, that list, and how often it has each."""
        self.known.room()
        if not self.known.at:
            self.bad.clear()
        names, sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t and MARK not in t:
                own = stretches.cut(f" {t}")[1:]
                sizes[i] = len(own)
                names += own
        rows = self.known.find(names)
        if self.bad:
            # texts whose bytes come out otherwise have no tokens
            wrong = np.fromiter((x in self.bad for x in names), bool, len(names))
            text_of = np.repeat(np.arange(len(texts)), sizes)
            out = np.zeros(len(texts), bool)
            out[text_of[wrong]] = True
            rows, sizes = rows[~out[text_of]], np.where(out, 0, sizes)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        ids, ends, starts, owner = [], [], [], []
        for side in (0, 1):
            own, n = self.known.take(side, rows)
            size = self.size[side][own]
            end = np.cumsum(size)
            ids.append(own)
            ends.append(end)
            starts.append(end - size)
            owner.append(np.repeat(text_of, n))
        i, j = overlaps(starts)
        n = len(texts)
        together = ends[0][i] == ends[1][j]
        partner = np.full(len(ids[0]), -1, np.int64)
        partner[i[together]] = j[together]
        a = np.flatnonzero(partner >= 0)  # links, in order: places of both tokens
        b = partner[a]
        counts = {"n_a": np.bincount(owner[0], minlength=n), "n_b": np.bincount(owner[1], minlength=n), "n_links": np.bincount(owner[0][a], minlength=n), "n_overlaps": np.bincount(owner[0][i], minlength=n)}
        counts["n_groups"] = counts["n_links"]  # two tokens of one side never end together
        digests = self.digests(ids, a, b, counts)
        pair = (ids[0][a].astype(np.int64) << 32) | ids[1][b]
        import pandas as pd

        number, listed = pd.factorize(pair)
        stops = np.cumsum(counts["n_links"])
        return counts, digests, np.split(number, stops[:-1]), np.asarray(listed, np.int64), np.bincount(number, minlength=len(listed))

    def digests(self, ids: list[np.ndarray], a: np.ndarray, b: np.ndarray, counts: dict[str, np.ndarray]) -> list[str]:
        """The digest of each text's groups; '' without tokens."""
        last_a, last_b = np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool)
        last_a[a], last_b[b] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before = np.concatenate(([0], b[:-1] + 1)) if len(b) else np.zeros(0, np.int64)  # tokens of the other side in the groups before
        line = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        line[np.arange(len(ids[0])) + before[group_a]] = ids[0] * 4 + last_a
        line[np.arange(len(ids[1])) + a[group_b] + 1] = ids[1] * 4 + 2 * last_b
        stops = np.cumsum(counts["n_a"] + counts["n_b"])
        ended = stops[(counts["n_a"] + counts["n_b"]) > 0] - 1
        line[ended] += 1
        told, out, first = self.told, [], 0
        for stop in stops.tolist():
            out.append(hashlib.sha256(b"".join(map(told.__getitem__, line[first:stop].tolist()))).hexdigest() if stop > first else "")
            first = stop
        return out


def overlaps(starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of both sides that overlap, each pair once."""
    import pandas as pd

    sides = [pd.DataFrame({"start": s, f"at{k}": np.arange(len(s))}) for k, s in enumerate(starts)]
    over_a = pd.merge_asof(sides[0], sides[1], on="start")  # the token of the right that covers each start of the left
    over_b = pd.merge_asof(sides[1], sides[0], on="start")
    i, j = over_b["at0"].to_numpy(np.int64), over_b["at1"].to_numpy(np.int64)
    new = starts[0][i] != starts[1][j]  # where both start together both directions find the pair
    return np.concatenate((over_a["at0"].to_numpy(np.int64), i[new])), np.concatenate((over_a["at1"].to_numpy(np.int64), j[new]))


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def blocks(docs: DataFrame, a: str, b: str, key: str, text: str) -> DataFrame:
    """A row for each text with its block, counts, digest and links, and one for each block with its id pairs and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, group in stretches.groups([t or "" for t in texts], BLOCK):
                counts, digests, links, listed, times = own.align(group)
                kind = np.uint16 if len(listed) <= 1 << 16 else np.uint32
                more = len(group) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(more, block), pa.int64()),
                        pa.concat_arrays([batch.column(0).slice(first, len(group)), pa.nulls(1, batch.column(0).type)]),
                        *(pa.array([*counts[c].tolist(), None], pa.int64()) for c in COUNTS),
                        pa.array([*digests, None], pa.string()),
                        pa.array([*(x.astype(kind).tobytes() for x in links), None], pa.binary()),
                        pa.array([*[None] * len(group), listed.tolist()], pa.list_(pa.int64())),
                        pa.array([*[None] * len(group), times.tolist()], pa.list_(pa.int64())),
                    ],
                    names=["block", "_key", *COUNTS, "groups_sha256", "links", "pairs", "times"],
                )
                block += 1

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"block long, _key {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, links binary, pairs array<long>, times array<long>"
    )


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n and whether n is the highest of its b: over all links of the corpus."""
    pairs = found.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    n = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    n = n.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n")
    top = n.groupBy("b").agg(F.max("n").alias("_top"))
    return n.join(top, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every row.

    A null or empty text, and one whose tokens' bytes aren't those of a space and the text, has
    no tokens: zeros and ''.  Ids that are equally often linked are all the best.  Rows repeated
    count each; a null key stays null, an empty table gives an empty one, other columns aren't read.
    """
    default = default_paths()
    found = stage(blocks(docs, a or default[0], b or default[1], key, text), "alignments")
    counts = stage(pair_counts(found).select("pair", "n", "best"), "pair-counts")
    asked = found.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select(F.col("block").alias("asked_by"), "at", "n", "best")
    texts = found.where("pairs is null").drop("pairs", "times")

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["at"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        sizes = left["n_links"].to_numpy()
        kind = np.uint16 if len(n) <= 1 << 16 else np.uint32
        links = np.frombuffer(b"".join(left["links"].to_pylist()), kind)
        stops = np.concatenate(([0], np.cumsum(sizes)))
        for name, values in (("n_best", best), ("count_sum", n)):
            sums = np.concatenate(([0], np.cumsum(values[links])))
            left = left.append_column(name, pa.array(sums[stops[1:]] - sums[stops[:-1]], pa.int64()))
        return left.drop_columns(["block", "links"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, n_best long, count_sum long"
    rows = texts.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(told, schema)
    return rows.select(F.col("_key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
