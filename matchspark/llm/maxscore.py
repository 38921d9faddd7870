"""Exact top-k inner products by MaxScore.

A component is a term of a vector. In each shard of candidates a term's bound for a query is the most that any candidate of
the shard can gain from it. The terms with the smallest bounds, as far as their sum stays below a share of the query's k-th
best score so far, are non-essential. The postings of the essential terms are traversed for all queries of a block at once (a
matrix product in which non-essential weights are zero); of the candidates that the bounds of the rest could still lift to the
k-th score, the rest is probed group by group, and those that fall behind are dropped. Shards are merged at the end. The first
thresholds come from a bounded sample of the candidates; they are scores of real candidates, so no result is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.session import cut_lineage

#: Candidates of a shard.
SHARD = 4096
#: Candidates whose best scores give the first thresholds (about; dealt by a hash).
SEED_ROWS = 8192
#: Bytes of a block of queries, which every task holds.
QUERY_BYTES = 4 << 20
#: Part of the threshold up to which the bounds of non-essential terms may sum.
SHARE = 0.4
#: Non-essential terms probed at a time.
GROUP = 8
#: Below this, sums of products are exact in double precision.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = "query_id long, vec_id long, score long"


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as doubles where these are exact and as Python integers otherwise."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if not out.size or np.abs(out).max() < EXACT:
        return out
    return np.frompyfunc(lambda v: scale * int(v) if abs(v) >= EXACT else math.floor(scale * v), 1, 1)(x)


def matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``column`` that take part, and their scaled vectors, short ones filled with zeros."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size]))
    size, start = size[good], (ends - size)[good]
    out = np.zeros((len(good), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(good)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = flat[np.repeat(start, size) + place]
    return good, scaled(out, scale)


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)])


@dataclass
class Block:
    """A block of queries (ids ascending), and the k-th best score each is known to reach."""

    ids: np.ndarray
    vectors: np.ndarray
    least: np.ndarray


@dataclass
class Best:
    """The best candidates so far: query (its place in the block), score, id; at most k a query."""

    query: np.ndarray
    score: np.ndarray
    vec_id: np.ndarray

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> Best:
        query, score, vec_id = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, query))
        query = query[order]
        held = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
        return Best(query[held], score[order][held], vec_id[order][held])


def same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same width, and as Python integers where doubles may not hold their products exactly."""
    width = max(a.shape[1], b.shape[1], 1)
    a, b = widened(a, width), widened(b, width)
    if object not in (a.dtype, b.dtype) and (not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * width < EXACT):
        return a, b
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object), whole(b).astype(object)


def competitive(block: Block, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact score) of all pairs that reach ``least``, the k-th best scores so far (-inf: none yet)."""
    weights, cells = same_kind(block.vectors, vectors)
    columns = np.ascontiguousarray(cells.T)
    bound = np.maximum(weights * columns.max(1), weights * columns.min(1))
    order = np.argsort(bound.astype(float), axis=1, kind="stable")
    reach = np.cumsum(np.take_along_axis(bound, order, 1), axis=1)  # what the first terms in order can add
    within = reach.astype(float) <= np.where(np.isfinite(least), SHARE * np.maximum(least, 0), -np.inf)[:, None]
    n_rest = np.where(within.all(1), within.shape[1], np.argmin(within, axis=1))
    place = np.argsort(order, axis=1)
    score = np.where(place >= n_rest[:, None], weights, 0) @ columns
    lift = np.where(n_rest > 0, np.take_along_axis(reach, np.maximum(n_rest - 1, 0)[:, None], 1)[:, 0], 0)
    own = np.searchsorted(block.ids, ids)
    hit = np.flatnonzero(block.ids[np.minimum(own, len(block.ids) - 1)] == ids)
    able = np.ones(score.shape, bool)
    able[own[hit], hit] = False
    floor = least.astype(object) if score.dtype == object else least.copy()
    for q in np.flatnonzero(~np.isfinite(least)):  # every term is essential: the shard's own k-th best will do
        there = np.sort(score[q][able[q]])
        if len(there) >= k:
            floor[q] = there[-k] if score.dtype != object else min(there[-k], MOST) if there[-k] > LEAST else -np.inf
    able &= (score + lift[:, None] >= floor[:, None]).astype(bool)
    query, at = np.nonzero(able)
    score, left = score[query, at], n_rest[query]
    while (left > 0).any():  # probe the others from the largest bound down
        todo = np.flatnonzero(left > 0)
        q, v = query[todo], at[todo]
        for j in range(1, GROUP + 1):
            there = np.flatnonzero(left[todo] >= j)
            term = order[q[there], left[todo][there] - j]
            score[todo[there]] += weights[q[there], term] * cells[v[there], term]
        left[todo] = np.maximum(left[todo] - GROUP, 0)
        keep = (score + np.where(left > 0, reach[query, np.maximum(left - 1, 0)], 0) >= floor[query]).astype(bool)
        query, at, score, left = query[keep], at[keep], score[keep], left[keep]
    return query, at, score


def search(shards: Iterator[tuple[np.ndarray, np.ndarray]], block: Block, k: int) -> Best:
    """The k best candidates of each query of ``block`` in ``shards`` (ids, vectors), none below the block's thresholds."""
    best, least = Best(*(np.zeros(0, t) for t in (np.int64, float, np.int64))), block.least.copy()
    for ids, vectors in shards:
        query, at, score = competitive(block, least, ids, vectors, k)
        if score.dtype == object:
            score = np.clip(score, LEAST, MOST)
            best.score = best.score if best.score.dtype == object else np.frompyfunc(int, 1, 1)(best.score).astype(object)
        best = best.add(query, score, ids[at], k)
        last = np.searchsorted(best.query, np.arange(len(block.ids)), "right") - 1
        full = np.flatnonzero(np.bincount(best.query, minlength=len(block.ids)) == k)
        now = best.score[last[full]]
        now = np.where(now <= LEAST, -np.inf, now) if now.dtype == object else now
        least = least.astype(object) if now.dtype == object else least
        least[full] = np.maximum(least[full], now)
        least = np.where(np.isfinite(least.astype(float)), least, -np.inf)
        least = least if least.dtype == object and max((abs(x) for x in least if x != -np.inf), default=0) >= EXACT else least.astype(float)
    return best


def shards_of(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the rows that take part, SHARD at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SHARD:
            yield from cut(held, scale)
            held, rows = [], 0
    if rows:
        yield from cut(held, scale)


def cut(batches: list[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    table = pa.Table.from_batches(batches)
    good, vectors = matrix(table.column(1).combine_chunks(), scale)
    ids = table.column(0).to_numpy()[good]
    for lo in range(0, len(ids), SHARD):
        yield ids[lo:lo + SHARD], vectors[lo:lo + SHARD]


def found(candidates: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """Each task's best candidates for the queries of ``block``."""
    held = candidates.sparkSession.sparkContext.broadcast(block)  # QUERY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search(shards_of(batches, scale), held.value, k)
        score = pa.array([int(x) for x in best.score], pa.int64()) if best.score.dtype == object else pa.array(best.score.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(held.value.ids[best.query]), pa.array(best.vec_id), score], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, RESULT)


def merged(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def maxscore_search(
    vectors: DataFrame, asks: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, every: int = 100,
) -> DataFrame:
    """The k highest integer inner products of each query with all rows of ``vectors``: query_id, rank, vec_id, score.

    Queries are the rows of ``asks``, by default the rows of ``vectors`` whose id is divisible by ``every``; rows with the
    query's own id are left out. Components are floor(scale * x); scores are exact, ties go to the smaller id, and a score
    beyond 64 bits counts as the nearest 64-bit number. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; missing components of shorter vectors are zero. A candidate row written more than once is
    found each time; query rows that share an id ask once, with the smallest vector. Other columns are ignored. Queries with
    fewer than k candidates return all; an empty table gives an empty result.
    """
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull())
    rows = plain(vectors)
    asked = plain(asks) if asks is not None else rows.where(F.col("vec_id") % every == 0)
    usable = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = cut_lineage(asked.where(usable).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n = rows.count() if size.n else 0
    blocks = max(1, math.ceil(size.n * max(size.width or 1, 1) * 8 / QUERY_BYTES))
    seeds = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, n // SEED_ROWS))) == 0)  # for thresholds alone
    out = []
    for b in range(blocks):  # each block of queries, of bounded size, passes over all rows
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks().sort_by("vec_id")
        if not part.num_rows:
            continue
        ids, vecs = part.column("vec_id").to_numpy(), matrix(part.column("vector").combine_chunks(), scale)[1]
        block = Block(ids, vecs, np.full(len(ids), -np.inf))
        if n > SEED_ROWS:
            first = merged(found(seeds, block, k, scale), k).where(F.col("rank") == k).select("query_id", "score").collect()  # a row a query of the block
            start = {r.query_id: r.score for r in first if LEAST < r.score and abs(r.score) < EXACT}
            block = Block(ids, vecs, np.array([start.get(i, -np.inf) for i in ids.tolist()], float))
        out.append(cut_lineage(found(rows, block, k, scale)))
    if not out:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return merged(whole, k).select("query_id", "rank", "vec_id", "score")
