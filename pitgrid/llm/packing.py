"""Best-fit packing of documents into sequences of a fixed number of tokens.

Hierarchical residual packing: the pieces of documents are dealt by hash to leaves of bounded
size, and each leaf is packed by best fit, longest pieces first.  Of a leaf's sequences the full
ones are done, and the underfull ones become items of the leaf's parent, which is packed by best
fit again, and so on up a tree of fan ``FAN`` to its root.

What moves up is bounded without loss.  After best fit no two sequences of a node fit into one,
so at most one of them is half full or less; a parent therefore has at most ``FAN`` items that
can fill others' gaps, and of sequences with one fill no more than ``FAN`` can take one.  A node
sends up its emptiest sequence and ``FAN`` of each other fill, and the rest are done.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgrid.llm import stretches
from pitgrid.llm.staging import stage

LIMIT, END = 1024, 2
#: Pieces in a leaf, on average, and children of a node.
LEAF, FAN = 1 << 15, 8
#: Code points of texts that are encoded together.
GROUP = 1 << 22

_tables: dict[str, stretches.StretchTable] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(path: str) -> stretches.StretchTable:
    """The worker's table of stretches and their ids."""
    if path not in _tables:
        _tables[path] = stretches.StretchTable(stretches.ByteBpe(path, False))
    return _tables[path]


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece, start, length, ids_crc32 of the pieces into which documents are cut.

    A document is the ids of its text, without added special tokens, and ``end``.  One of more
    than ``limit`` tokens is cut so that all its pieces but the first have ``limit`` of them.  A
    null text counts as empty and has ``end`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table(path or default_path())
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for first, texts in stretches.groups(batch.column(1).to_pylist(), GROUP):
                known.room()
                names, sizes = [], np.empty(len(texts), np.int64)
                for i, t in enumerate(texts):
                    own = cut(t)
                    sizes[i] = len(own)
                    names += own
                ids, n = known.take(0, known.find(names))
                stops = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))]
                told, last = ids.astype("<u4").tobytes(), np.uint32(end).astype("<u4").tobytes()
                for i in range(len(texts)):
                    own = told[4 * stops[i] : 4 * stops[i + 1]] + last
                    total = len(own) // 4
                    count = -(-total // limit)
                    a, z = 0, total - (count - 1) * limit
                    for k in range(count):
                        row.append(first + i)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(own[4 * a : 4 * z]))
                        a, z = z, z + limit
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


def cut(text: str) -> list:
    """The names of a text's stretches; the first has no space before it."""
    own: list = stretches.cut(text)
    own[0] = (own[0],)
    return own


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest items first, each into the fullest bin that has room."""
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by room left
    rooms = 0  # bit r is set where a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        able = rooms >> size
        if able:
            room = size + (able & -able).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), limit
            fills.append(0)
        bins[i], offsets[i] = b, limit - room
        fills[b] = limit - room + size
        if room > size:
            free[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def sent_up(fills: np.ndarray, limit: int) -> np.ndarray:
    """Which bins of a node its parent gets: ``FAN`` of each fill, none of the full ones."""
    order = np.argsort(fills, kind="stable")
    ranked = fills[order]
    rank = np.arange(len(fills)) - np.searchsorted(ranked, ranked)
    up = np.empty(len(fills), bool)
    up[order] = rank < FAN
    return up & (fills < limit)


def fitted(items: DataFrame, level: int, root: bool, limit: int) -> DataFrame:
    """``items`` (node, item, size and others) with their bin, its fill, their offset in it, and whether the bin goes up."""

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by("item")
        bins, offsets, fills = best_fit(part["size"].to_numpy(), limit)
        up = np.zeros(len(fills), bool) if root else sent_up(fills, limit)
        name = (level << 58) + (part["node"][0].as_py() << 20)
        new = {"bin": pa.array(name + bins), "offset": pa.array(offsets), "fill": pa.array(fills[bins]), "up": pa.array(up[bins])}
        for k, v in new.items():
            part = part.append_column(k, v)
        return part

    added = [T.StructField(c, T.LongType()) for c in ("bin", "offset", "fill")] + [T.StructField("up", T.BooleanType())]
    return items.groupBy("node").applyInArrow(fit, T.StructType([*items.schema.fields, *added]))


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id, offset: where each piece of ``docs`` lies.

    Sequences hold at most ``limit`` tokens, without gaps from offset 0.  Rows repeated or with
    a null key are packed like others, a null text has the end token alone, pieces of one size
    are taken in a fixed order, an empty table gives an empty one; other columns aren't read.
    """
    cutup = pieces(docs, path, limit, end, key, text).toDF("_key", "piece", "start", "length", "ids_crc32")
    cutup = stage(cutup.withColumn("item", F.monotonically_increasing_id()), "pieces")
    nodes = max(1, -(-cutup.count() // LEAF))
    items = cutup.withColumns({"size": F.col("length"), "node": F.pmod(F.xxhash64("item"), F.lit(nodes)).cast("long")})
    levels: list[DataFrame] = []
    while True:
        levels.append(stage(fitted(items, len(levels), nodes == 1, limit), f"packed-{len(levels)}"))
        if nodes == 1:
            break
        # one row for each sequence that goes up: that of the item at its start
        items = levels[-1].where("up and offset = 0").select(F.floor(F.col("node") / FAN).alias("node"), F.col("bin").alias("item"), F.col("fill").alias("size"))
        nodes = -(-nodes // FAN)
    place = None
    for level in reversed(levels):
        if place is None:
            found = level.withColumn("sequence_id", F.col("bin"))
        else:
            moved = level.where("up").join(place, "bin").withColumn("offset", F.col("offset") + F.col("_by")).drop("_by")
            found = level.where("not up").withColumn("sequence_id", F.col("bin")).unionByName(moved)
        place = found.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("_by"))
    return found.select(F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
