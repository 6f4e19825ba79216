"""Exact top-k search by inner product, block at a time.

Components become the integers floor(256 * x). Vectors are put in an order that brings like ones
together (nearest of a few centres fitted on a bounded sample, then signs along its main axes) and
cut into ranges of ``BLOCK`` vectors. A block keeps its vectors (the forward index) and, for each
component, the largest and smallest value: a query's product with a block is at most the sum of its
terms' maxima (largest value for a positive query component, smallest for a negative one).

Each query is scored in its own shard of blocks first, which gives a lower bound of its k-th best
score. Then every (shard, slice of queries) is one task: a query takes the shard's blocks in the
order of falling bounds, in runs of 1, 2, 4, ... blocks, and stops when the bounds fall below its
k-th best score so far. Blocks equal to that score are still read, as ties go to the smaller id.
The order only decides how much is skipped; every row is in exactly one block, so results are exact.
A task holds at most about ``CELL`` vectors and ``CELL`` queries; shards grow in number with the rows.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part (an empty
vector does, with product 0); shorter vectors count as padded with zeros; repeated rows are rows of
their own, and only the query's own row is left out; a null id is no query and comes last in ties;
fewer than k other rows give fewer results; an empty table gives an empty result; other columns are
ignored. Products beyond 2 ** 53 are counted in whole numbers of any size; a result outside a long is
an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratinglab.llm.common import table, written
from ratinglab.session import ship_package

K = 5
QUERY_STEP = 50
FINE = 256.0
BLOCK = 64
#: Vectors of a shard, queries of a slice: the bound of one task's input.
CELL = 1 << 16
#: Fewest vectors for which a shard of its own is worth a task.
SMALL = 1 << 11
#: Rows for fitting the order, centres, and axes whose signs refine it.
SAMPLE, CENTRES, AXES, ROUNDS = 4096, 64, 12, 5
#: Queries scored together in a task.
TOGETHER = 1024
#: Candidates kept before they are cut to k for each query.
KEPT = 1 << 20

_ROW = "vec_id bigint, v array<double>, q boolean, key bigint"
_BLOCK = "shard int, no int, ids array<bigint>, q array<boolean>, dim int, v array<double>, high array<double>, low array<double>"
_HOME = "shard int, no int, pos int, query_id bigint, v array<double>, floor double, ids array<bigint>, scores array<bigint>"
_FOUND = "shard int, no int, pos int, query_id bigint, vec_id bigint, score bigint"


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (null: NaN) and lengths of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), size


def matrix(flat: np.ndarray, size: np.ndarray, dim: int) -> np.ndarray:
    """One row for each list, padded with zeros or cut to ``dim`` components."""
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < dim], at[at < dim]] = flat[at < dim]
    return out


def nested(flat: np.ndarray, size: np.ndarray, kind=None) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, kind))


def fitted(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and main axes of the sample (a few Lloyd steps from evenly spaced rows)."""
    if not len(sample):
        return np.zeros((1, 1)), np.zeros((0, 1))
    centres = sample[np.unique(np.linspace(0, len(sample) - 1, CENTRES).astype(int))]
    for _ in range(ROUNDS):
        near = nearest(sample, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    left = sample - centres[nearest(sample, centres)]
    scale = max(1.0, float(np.abs(left).max()))
    axes = np.linalg.eigh((left / scale).T @ (left / scale))[1][:, ::-1].T[:AXES]
    return centres, axes


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2.0 * (rows @ centres.T), axis=1)


def _rows(batches, centres: np.ndarray, axes: np.ndarray):
    """Whole-number vectors that take part, with their place in the order."""
    dim = centres.shape[1]
    for batch in batches:
        column = batch.column("v")
        flat, size = lists(column)
        owner = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(owner, weights=~np.isfinite(flat), minlength=len(size)) > 0
        keep = ~bad & column.is_valid().to_numpy(zero_copy_only=False)
        flat, size = np.floor(FINE * flat[keep[owner]]), size[keep]
        vectors = matrix(flat, size, dim)
        near = nearest(vectors, centres)
        key = near.astype(np.int64)
        if len(axes):
            side = ((vectors - centres[near]) @ axes.T > 0).astype(np.int64)
            key = key << AXES | side @ (1 << np.arange(len(axes))[::-1])
        kept = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q")], ["vec_id", "q"]).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept.column(0), nested(flat, size), kept.column(1), pa.array(key)],
                                         ["vec_id", "v", "q", "key"])


def _blocks(batches):
    """The partition's rows in their order, ``BLOCK`` to a row."""
    shard, no, wait = TaskContext.get().partitionId(), 0, None

    def block(rows: pa.Table):
        nonlocal no
        flat, size = lists(rows.column("v"))
        dim = int(size.max())
        m = matrix(flat, size, dim)
        no += 1
        one = lambda x: pa.array([x])
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([no - 1], pa.int32()), one(rows.column("vec_id").to_pylist()).cast(pa.list_(pa.int64())),
             one(rows.column("q").to_pylist()), pa.array([dim], pa.int32()), one(m.ravel()).cast(pa.list_(pa.float64())),
             one(m.max(axis=0)).cast(pa.list_(pa.float64())), one(m.min(axis=0)).cast(pa.list_(pa.float64()))],
            ["shard", "no", "ids", "q", "dim", "v", "high", "low"])
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if wait is None else pa.concat_tables([wait, rows])
        whole = len(rows) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            yield block(rows.slice(a, BLOCK))
        wait = rows.slice(whole).combine_chunks()
    if wait is not None and len(wait):
        yield block(wait)


class Shard:
    """The blocks of one shard: forward index and term maxima."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("shard", "ascending"), ("no", "ascending")])
        dims = rows.column("dim").to_numpy().astype(np.int64)
        self.dim = int(dims.max()) if len(dims) else 0
        self.no = rows.column("no").to_numpy()
        self.size = pc.list_value_length(rows.column("ids")).to_numpy().astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = rows.column("ids").combine_chunks().flatten()
        self.asked = rows.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)
        flat, _ = lists(rows.column("v"))
        self.v = matrix(flat, np.repeat(dims, self.size), self.dim)
        self.high, self.low = (matrix(*lists(rows.column(c)), self.dim) for c in ("high", "low"))


def whole(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape)


def search(shard: Shard, vectors: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """(query, row of the shard, score) of each query's k best rows of the shard that reach its
    ``floor`` (-inf: none). ``own``: the query's own row in this shard, -1 if it is in another."""
    dim = max(shard.dim, vectors.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1])))
    vectors, v, high, low = wide(vectors), wide(shard.v), wide(shard.high), wide(shard.low)
    if not len(v) or not len(vectors):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    most = np.abs(vectors).max(initial=0.0) * np.abs(v).max(initial=0.0) * max(dim, 1)
    if most >= 2.0 ** 53:  # products no double can hold
        vectors, v, high, low = (whole(m) for m in (vectors, v, high, low))
        floor = floor.astype(object)
    # order of ids, null last
    rank = np.argsort(np.asarray(pc.sort_indices(shard.ids, null_placement="at_end")))
    n_blocks, found = len(shard.size), []
    for a in range(0, len(vectors), TOGETHER):
        some = vectors[a:a + TOGETHER]
        least = floor[a:a + TOGETHER].copy()
        mine = own[a:a + TOGETHER]
        best = np.full((len(some), k), -np.inf, dtype=some.dtype)
        bound = np.maximum(some, 0) @ high.T + np.minimum(some, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        hits, held, lo, step = [], 0, 0, 1

        def cut(hits):
            if not hits:
                return []
            q, r, s = (np.concatenate(x) for x in zip(*hits))
            keep = s >= least[q]
            q, r, s = q[keep], r[keep], s[keep]
            by = np.lexsort((rank[r], -s, q)) if s.dtype != object else np.array(
                sorted(range(len(q)), key=lambda i: (q[i], -s[i], rank[r[i]])), dtype=np.int64)
            q, r, s = q[by], r[by], s[by]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1, [len(q)]]) if len(q) else np.zeros(1, int)
            place = np.arange(len(q)) - np.repeat(begin[:-1], np.diff(begin))
            return [(q[place < k], r[place < k], s[place < k])]
        while lo < n_blocks:
            hi = min(n_blocks, lo + step)
            live = bound[:, lo:hi] >= least[:, None]
            if not live[:, 0].any():
                break  # bounds fall, so no later block can reach
            asker, at = np.nonzero(live)
            block = order[:, lo:hi][asker, at]
            by = np.argsort(block, kind="stable")
            asker, block = asker[by], block[by]
            begin = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for x, y in zip(begin[:-1], begin[1:]):
                r0, r1 = shard.first[block[x]], shard.first[block[x] + 1]
                who = asker[x:y]
                who = who[bound[who, lo] >= least[who]]
                score = some[who] @ v[r0:r1].T
                inside = (mine[who] >= r0) & (mine[who] < r1)
                score[np.flatnonzero(inside), mine[who][inside] - r0] = -np.inf
                hit = (score >= least[who][:, None]) & (score > -np.inf)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                hits.append((who[i], r0 + j, score[i, j]))
                held += len(i)
                on = np.unique(i)
                top = np.sort(np.concatenate([best[who[on]], score[on]], axis=1), axis=1)[:, -k:]
                best[who[on]] = top
                least[who[on]] = np.maximum(least[who[on]], top[:, 0])
                if held > KEPT:
                    hits = cut(hits)
                    held = len(hits[0][0])
            lo, step = hi, step * 2
        for q, r, s in cut(hits):
            found.append((q + a, r, s))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    q, r, s = (np.concatenate(x) for x in zip(*found))
    return q, r, (np.array([int(x) for x in s], np.int64) if s.dtype == object else s.astype(np.int64))


def _home(k: int):
    """The queries of a shard with their best rows in it and their k-th best score there."""
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        own = np.flatnonzero(shard.asked)
        q, r, s = search(shard, shard.v[own], own, np.full(len(own), -np.inf), k)
        by = np.lexsort((np.arange(len(q)), q))
        q, r, s = q[by], r[by], s[by]
        count = np.bincount(q, minlength=len(own))
        last = np.cumsum(count) - 1
        # a lower bound as a double: rounded down where the score is beyond 2 ** 53
        floor = [np.nextafter(float(s[e]), -np.inf) if n >= k and abs(int(s[e])) >= 1 << 53 else float(s[e]) if n >= k else None
                 for n, e in zip(count.tolist(), last.tolist())]
        block = np.searchsorted(shard.first, own, side="right") - 1
        return pa.table({
            "shard": pa.array(np.full(len(own), rows.column("shard")[0].as_py()), pa.int32()),
            "no": pa.array(shard.no[block], pa.int32()), "pos": pa.array(own - shard.first[block], pa.int32()),
            "query_id": shard.ids.take(pa.array(own)), "v": nested(shard.v[own].ravel(), np.full(len(own), shard.dim)),
            "floor": pa.array(floor, pa.float64()), "ids": pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), shard.ids.take(pa.array(r))),
            "scores": nested(s, count, pa.int64())})
    return run


def _away(k: int):
    """Best rows of a shard for queries of other shards."""
    names = ["shard", "no", "pos", "query_id", "vec_id", "score"]

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        shard = Shard(blocks)
        flat, size = lists(queries.column("v"))
        floor = pc.fill_null(queries.column("floor"), -np.inf).to_numpy()
        q, r, s = search(shard, matrix(flat, size, int(size.max(initial=0))), np.full(len(size), -1), floor, k)
        asked = queries.select(names[:4]).take(pa.array(q))
        return asked.append_column("vec_id", shard.ids.take(pa.array(r))).append_column("score", pa.array(s, pa.int64()))

    def checked(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(blocks) or not len(queries):
            kinds = [pa.int32()] * 3 + [pa.int64()] * 3
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        return run(blocks, queries)
    return checked


def blocks_of(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, int]:
    """The written block table, and its number of shards."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"),
                     F.coalesce(is_query, F.lit(False)).alias("q"))
    good = rows.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    sample = [r.v for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    size = np.array([len(x) for x in sample], np.int64)
    flat = np.floor(FINE * np.array([x for v in sample for x in v], float))
    centres, axes = fitted(matrix(flat, size, max(1, int(size.max(initial=1)))))
    n = rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // CELL), min(tasks, -(-n // SMALL)))
    ordered = rows.mapInArrow(lambda b: _rows(b, centres, axes), _ROW).withColumn("salt", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(shards, "key", "salt").sortWithinPartitions("key", "salt")
    return written(ordered.mapInArrow(_blocks, _BLOCK), "topk-blocks"), shards


def top_k(df: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row where ``is_query`` holds, the k other
    rows of highest inner product, ties to the smaller id."""
    ship_package(df.sparkSession)
    blocks, _ = blocks_of(df, is_query, id_column, vector_column)
    home = written(blocks.groupBy("shard").applyInArrow(_home(k), _HOME), "topk-home")
    slices = max(1, -(-home.count() // CELL))
    shards = [r.shard for r in blocks.select("shard").distinct().collect()]  # one row for each shard
    there = F.explode(F.filter(F.lit(sorted(shards)).cast("array<int>") if shards else F.array().cast("array<int>"),
                               lambda s: s != F.col("shard")))
    queries = home.select("shard", "no", "pos", "query_id", "v", "floor", there.alias("there"),
                          F.pmod(F.xxhash64("shard", "no", "pos"), F.lit(slices)).cast("int").alias("slice"))
    copies = blocks.select("*", F.col("shard").alias("there"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    away = copies.groupBy("there", "slice").cogroup(queries.groupBy("there", "slice")).applyInArrow(_away(k), _FOUND)
    found = home.select("shard", "no", "pos", "query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = Window.partitionBy("shard", "no", "pos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.unionByName(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


ORACLE = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({FINE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
found AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.r <> c.r WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM found)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
