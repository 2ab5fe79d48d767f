"""Exact top-k search by inner product, score at a time over an impact-ordered index.

Vectors are cut to integers, so a component is the impact of its row in the posting list of
its dimension.  Rows are dealt into shards and the queries into blocks; a shard is indexed
once for all queries of a block: impacts are quantised by size, the postings of one quantised
impact are a segment, and segments are taken from the largest impact down.  A segment adds
to the scores of all rows for all queries that are still open.  What a row has in later
segments is bounded by the segment's floor (times the query's sum of weights) and by the norm
of the row's components still out (times the query's norm), so each score is bounded from
above and below.  Rows whose upper bound stays under the k-th best lower bound are proven
out.  When the rows left are few, or everything is in, these are scored again exactly.  The
shards' k best meet in a ranking by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.llm.staging import stage

SHARD_ROWS = 8192
#: Queries that meet a shard in one group, and those that are scored at a time.
BLOCK_QUERIES, AT_ONCE = 4096, 64
#: Floors of the quantised impacts as parts of the largest one.
FLOORS = (0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.04, 0.0)
#: Possible members are scored exactly once they are at most this part of all pairs.
FEW = 1 / 64
SCALE = 256
#: Sums of products below this are exact as doubles.
EXACT = float(1 << 52)


class ImpactIndex:
    """Posting segments of one shard, from the largest quantised impact down."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        sizes = np.abs(vectors.astype(np.float64))
        self.largest = float(sizes.max(initial=0.0))
        self.floors = [np.floor(self.largest * part) for part in FLOORS]
        level = np.searchsorted(-np.array(self.floors), -sizes, side="right")  # a floor's own impact comes after it
        level[sizes == 0] = len(FLOORS)
        flat = level.ravel()
        order = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[order], np.arange(1, len(FLOORS) + 1))
        self.segments = [order[a:b] for a, b in zip([0, *ends], ends)]
        squares = np.stack([np.where(level > at, sizes, 0.0) for at in range(len(FLOORS))])
        #: For each floor the norm of what each row has below it.
        self.rest = np.sqrt(np.square(squares).sum(axis=2)) * (1 + 1e-9)

    def segment(self, at: int, rows: np.ndarray) -> np.ndarray:
        """The impacts of one segment as rows and dimensions, for ``rows``."""
        n, dims = self.vectors.shape
        out = np.zeros(n * dims)
        out[self.segments[at]] = self.vectors.ravel()[self.segments[at]]
        return out.reshape(n, dims)[rows]

    def best(self, queries: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, row, score) of the k best rows for each query, ties to smaller ids; rows with the query's own id take no part."""
        open_ = ids[:, None] != own[None, :]
        if self.largest * float(np.abs(queries.astype(np.float64)).max(initial=0.0)) * queries.shape[1] >= EXACT:
            return self.ranked(*np.nonzero(open_), queries, k, ids)
        weights = queries.astype(np.float64)
        total, norm = np.abs(weights).sum(axis=1), np.sqrt(np.square(weights).sum(axis=1)) * (1 + 1e-9)
        want = np.minimum(k, open_.sum(axis=0))
        rows = np.arange(len(ids))
        score = np.zeros(open_.shape)
        least = np.full(len(own), -np.inf)
        for at, floor in enumerate(self.floors):
            score += self.segment(at, rows) @ weights.T
            slack = np.minimum(floor * total[None, :], self.rest[at][rows][:, None] * norm[None, :])
            lower = np.where(open_, score - slack, -np.inf)
            if len(rows) > k:
                lower = np.partition(lower, len(rows) - k, axis=0)[len(rows) - k :]
            lower = np.sort(lower, axis=0)
            some = want > 0
            least[some] = np.maximum(least, lower[len(lower) - np.maximum(want, 1), np.arange(len(own))])[some]
            open_ &= score + slack >= least[None, :]
            if open_.sum() <= FEW * len(ids) * len(own):
                break
            live = open_.any(axis=1)
            rows, score, open_ = rows[live], score[live], open_[live]
        row, query = np.nonzero(open_)
        return self.ranked(rows[row], query, queries, k, ids)

    def ranked(self, row: np.ndarray, query: np.ndarray, queries: np.ndarray, k: int, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """The k best of the given pairs by exact score."""
        out = np.concatenate([self.exact(row[a : a + 65536], queries[query[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.empty(0, np.int64)])
        order = np.lexsort((ids[row], -1 - out, query))
        first = np.searchsorted(query[order], np.arange(len(queries)))
        take = order[np.arange(len(order)) - first[query[order]] < k]
        return list(zip(query[take].tolist(), row[take].tolist(), out[take].tolist()))

    def exact(self, row: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Scores of pairs; one beyond 64 bits is cut to the largest or smallest number."""
        own = self.vectors[row]
        if self.largest * float(np.abs(queries.astype(np.float64)).max(initial=0.0)) * queries.shape[1] < float(1 << 62):
            return np.einsum("nd,nd->n", own, queries)
        top = (1 << 63) - 1
        return np.array([max(-top - 1, min(top, sum(x * y for x, y in zip(a, b)))) for a, b in zip(own.tolist(), queries.tolist())], np.int64)


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and the cut components as array<long>; rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col(key).isNotNull() & x.isNotNull() & finite)
        .select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("v"))
        .distinct()
    )


def search(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query.

    Queries are the rows whose key is divisible by ``every``; all rows but those with the
    query's own key are searched.  Only vectors of the query's length are compared.  Rows
    with a null key, a null vector or a component that is null or not finite take no part;
    rows repeated in full count once.  Components and scores beyond 64 bits are cut to the
    largest or smallest number.  Other columns aren't read.
    """
    rows = stage(integers(vectors, key, vector), "integers")
    shards = max(1, -(-rows.count() // shard_rows))
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    # each shard meets each block: the copies of a shard grow with the queries, in blocks
    cell = F.col("shard") * F.lit(blocks) + F.col("block")
    candidates = rows.select("id", "v", F.lit(False).alias("is_query"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = queries.select("id", "v", F.lit(True).alias("is_query"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    both = candidates.select("id", "v", "is_query", cell.alias("cell")).unionByName(asked.select("id", "v", "is_query", cell.alias("cell")))

    def within(group: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        is_query = np.asarray(group["is_query"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids = group["id"].to_numpy()
        vectors_ = group["v"].combine_chunks()
        lengths = np.asarray(vectors_.value_lengths())
        flat, ends = vectors_.flatten().to_numpy(), np.cumsum(lengths)
        for length in np.unique(lengths[is_query]):
            own = np.flatnonzero((lengths == length) & ~is_query)
            if length == 0 or len(own) == 0:
                continue
            take = lambda at: flat[(ends[at] - length)[:, None] + np.arange(length)]  # noqa: B023, E731
            index, asked = ImpactIndex(take(own)), np.flatnonzero((lengths == length) & is_query)
            for a in range(0, len(asked), AT_ONCE):
                at = asked[a : a + AT_ONCE]
                out += [(int(ids[at[q]]), int(ids[own[row]]), score) for q, row, score in index.best(take(at), k, ids[own], ids[at])]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols)})

    near = both.groupBy("cell").applyInArrow(within, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with ints as (select distinct vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
flat as (select vec_id, len(v) as n, unnest(range(1, len(v) + 1)) as d, unnest(v) as x from ints),
scored as (select q.vec_id as query_id, c.vec_id, sum(q.x * c.x)::bigint as score
  from flat q join flat c on q.d = c.d and q.n = c.n and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by all)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank
  from scored) where rank <= 5"""
