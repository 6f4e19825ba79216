"""Item vectors and similarity joins.

For unit vectors, Euclidean distance below ``d0 = sqrt(2 - 2c)`` is the same as
``dot > c``. ``similar_items_exact`` finds every such pair. ``similar_items_keys`` is an
approximate equi-join on bucketed random projections, several to a key, that can miss pairs;
``similar_items_lsh`` is MLlib's, one projection to a table, which is only selective where
buckets are narrow against the data.

Exact plan: both sides are hashed to blocks, one cogrouped step per (block, block). Components are
put in the order of their energy (sum of squares over both sides); the dot over the first half plus the
product of the two rests' norms (Cauchy-Schwarz) bounds the whole dot from above, and only pairs whose
bound reaches the cutoff get a full dot (by one more matrix product where those are many). Joined with itself, a set's pairs are tested once and written in
both directions. No Cartesian product is planned, no side passes through the driver, and no pair
below the cutoff ever becomes a row.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratinglab.functions.vectors import as_vector, dot, l2_normalize
from ratinglab.operators import blocks
from ratinglab.session import ship_package

PAIR_SCHEMA = T.StructType([T.StructField("left_id", T.IntegerType()), T.StructField("right_id", T.IntegerType()),
                            T.StructField("dot", T.DoubleType())])


def normalized_vectors(item_vectors: DataFrame, vector_col: str = "item_vector") -> DataFrame:
    """F5 + F6: adds ``unit_vector`` and drops zero vectors (they have no direction)."""
    return (item_vectors.withColumn("unit_vector", l2_normalize(as_vector(vector_col)))
            .where(F.col("unit_vector").isNotNull()))


def zero_vector_count(item_vectors: DataFrame, vector_col: str = "item_vector") -> DataFrame:
    return item_vectors.where(l2_normalize(as_vector(vector_col)).isNull()).agg(F.count(F.lit(1)).alias("n_zero"))


def ratings_with_vectors(ratings: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Inner join of ratings with the model table."""
    return ratings.select("user_id", "item_id", "rating").join(item_vectors, "item_id", "inner")


def rated_item_vectors(item_vectors: DataFrame, rated: DataFrame) -> DataFrame:
    """Vectors of items that appear in ``rated`` (semi-join)."""
    return item_vectors.join(rated.select("item_id").distinct(), "item_id", "left_semi")


#: Vectors of a block, fewest that are worth one, elements of the matrices a cell works on at once.
ROWS, SMALL, TILE = 1 << 12, 1 << 7, 1 << 18
#: Rows of a slice of a bucket of hashed projections.
BUCKET_ROWS = 1 << 15
#: Where more than one pair in so many passes the bound, the rests of all pairs' dots are one matrix product.
DENSE = 32
#: Room for rounding between the bound and the dot.
SLACK = 1e-9


def energy_order(*sides: DataFrame) -> list[int]:
    """Component numbers, the largest sum of squares first (one number for each component)."""
    total: dict[int, float] = {}
    for df in sides:
        e = df.select(F.posexplode("unit_vector").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
        for r in e.collect():
            total[r["i"]] = total.get(r["i"], 0.0) + r["e"]
    return sorted(total, key=lambda i: (-total[i], i))


def _pairs_cell(order: list[int], cutoff: float, strict: bool, same: bool, count: bool):
    head = max(1, len(order) // 2)
    kinds = [("left_id", pa.int32()), ("right_id", pa.int32()), ("dot", pa.float64())]
    schema = pa.schema([("n_pairs", pa.int64()), ("n_full", pa.int64())] if count else kinds)

    def vectors(rows: pa.Table):
        v = rows.column("unit_vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[:, order]
        return rows.column("item_id").to_numpy(), v, np.sqrt((v[:, head:] ** 2).sum(axis=1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        (a, x, ax), (b, y, ay) = vectors(left), vectors(right)
        inside = same and left.column("lb")[0].as_py() == right.column("rb")[0].as_py()
        n_pairs = n_full = 0
        found = []
        step = blocks.row_block(len(b), TILE)
        for lo in range(0, len(a), step):
            part = x[lo:lo + step, :head] @ y[:, :head].T
            may = part + ax[lo:lo + step, None] * ay >= cutoff - SLACK
            if inside:  # each pair once, a vector with itself too
                once = a[lo:lo + step, None] <= b
                may &= once
                n_pairs += int(once.sum())
            else:
                n_pairs += may.size
            n_may = int(np.count_nonzero(may))
            n_full += n_may
            if n_may * DENSE > may.size:  # too many for one dot at a time
                part += x[lo:lo + step, head:] @ y[:, head:].T
                may &= part > cutoff if strict else part >= cutoff
                i, j = np.nonzero(may)
                found.append((a[i + lo], b[j], part[i, j]))
                continue
            i, j = np.nonzero(may)
            p = i + lo
            d = part[i, j] + np.einsum("ij,ij->i", x[p, head:], y[j, head:])
            hit = d > cutoff if strict else d >= cutoff
            found.append((a[p[hit]], b[j[hit]], d[hit]))
        if count:
            return pa.table({"n_pairs": [n_pairs], "n_full": [n_full]}, schema=schema)
        p, q, d = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
        if same:
            other = p != q
            p, q, d = np.concatenate([p, q[other]]), np.concatenate([q, p[other]]), np.concatenate([d, d[other]])
        return pa.table([pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(d)], schema=schema)
    return run


def _pairs(left: DataFrame, right: DataFrame | None, cutoff: float, strict: bool, count: bool) -> DataFrame:
    spark = left.sparkSession
    ship_package(spark)
    a = blocks.written(left.select("item_id", "unit_vector"), "unit-vectors")
    b = a if right is None else blocks.written(right.select("item_id", "unit_vector"), "unit-vectors")
    n = a.count()
    n_b = max(1, -(-b.count() // ROWS)) if right is not None else 0
    n_a = blocks.block_count(spark, n, ROWS, SMALL, n_b or 4)
    n_b = n_b or n_a
    cell = _pairs_cell(energy_order(*([a] if right is None else [a, b])), cutoff, strict, right is None, count)
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    return blocks.grid(a, b, blocks.hashed(n_a, "item_id"), blocks.hashed(n_b, "item_id"), n_a, n_b, cell,
                       "n_pairs bigint, n_full bigint" if count else PAIR_SCHEMA, "lb <= rb" if right is None else "true")


def similar_items_exact(left: DataFrame, right: DataFrame | None = None, cutoff: float = 0.4, strict: bool = True) -> DataFrame:
    """J6 exact: ``left_id, right_id, dot`` for all unit-vector pairs with dot > cutoff
    (``>=`` when ``strict=False``). Inputs carry ``item_id, unit_vector``. Without ``right``, left is
    joined with itself: both directions of every pair, and every vector with itself."""
    return _pairs(left, right, cutoff, strict, False)


def similarity_work(left: DataFrame, right: DataFrame | None = None, cutoff: float = 0.4) -> DataFrame:
    """One row ``n_pairs, n_full``: pairs of the join, and those of them that need a full dot."""
    work = _pairs(left, right, cutoff, True, True)
    return work.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("n_full"), F.lit(0)).alias("n_full"))


def similar_items_lsh(left: DataFrame, right: DataFrame, all_vectors: DataFrame, cutoff: float = 0.4,
                      tables: int = 5, seed: int = 42) -> DataFrame:
    """J6 + M7 as in the reference: ``BucketedRandomProjectionLSH`` with bucket length
    ``d0`` fitted on all unit vectors, ``approxSimilarityJoin(left, right, d0)``."""
    d0 = math.sqrt(2.0 - 2.0 * cutoff)
    def prep(df):
        return df.select("item_id", array_to_vector("unit_vector").alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=d0,
                                      numHashTables=tables, seed=seed).fit(prep(all_vectors))
    joined = lsh.approxSimilarityJoin(prep(left), prep(right), d0, distCol="dist")
    return joined.select(
        F.col("datasetA.item_id").alias("left_id"), F.col("datasetB.item_id").alias("right_id"),
        dot(vector_to_array(F.col("datasetA.v")), vector_to_array(F.col("datasetB.v"))).alias("dot"))


def lsh_draws(dim: int, tables: int, per_key: int = 6) -> list[list[tuple[list[int], float]]]:
    """Of each table, the projections of its key: signs for all components and a shift, from a hash."""
    out = []
    for t in range(tables):
        draws = [[hashlib.md5(f"lsh|{t}|{k}|{i}".encode()).digest()[0] for i in range(dim + 1)] for k in range(per_key)]
        out.append([([-1 if d & 1 else 1 for d in draw[:dim]], draw[dim] / 256) for draw in draws])
    return out


def sql_lsh_key(vector: str, signs: list[int], shift: float, width: float) -> str:
    terms = " ".join(f"{'-' if x < 0 else '+'} {vector}[{i + 1}]" for i, x in enumerate(signs))
    return f"floor(({terms.removeprefix('+ ')}) / CAST({width} AS DOUBLE) + CAST({shift} AS DOUBLE))"


def similar_items_keys(left: DataFrame, right: DataFrame, cutoff: float = 0.4, dim: int = 64, tables: int = 40,
                       width: float = 2.5) -> DataFrame:
    """J6 by equal (table, key), an exact filter, then distinct pairs. Wide buckets, many to a key,
    and many tables: pairs at the cutoff differ little more than any two vectors do. Both sides are cogrouped by
    table and bucket, large buckets in slices, and a bucket's candidates are tested as a matrix product: no pair
    below the cutoff becomes a row."""
    draws = [{"t": t, "key": [{"signs": signs, "shift": shift} for signs, shift in key]}
             for t, key in enumerate(lsh_draws(dim, tables))]
    draws = F.from_json(F.lit(json.dumps(draws)), "array<struct<t:int,key:array<struct<signs:array<double>,shift:double>>>>")

    def bucket(d):
        return F.floor(dot("unit_vector", d["signs"]) / width + d["shift"]).cast("int")

    def keyed(df):
        rows = F.transform(draws, lambda x: F.struct(x["t"].alias("t"), F.transform(x["key"], bucket).alias("k")))
        return df.select("item_id", "unit_vector", F.inline(rows))
    ship_package(left.sparkSession)
    a = blocks.written(keyed(left), "lsh-keys")
    b = a if right is left else blocks.written(keyed(right), "lsh-keys")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    n, n_b = (max(1, -(-df.where("t = 0").count() // ROWS)) for df in (a, b))
    # buckets of more rows on either side are cut in slices; there are few of them
    large = [df.groupBy("t", "k").count().where(F.col("count") > BUCKET_ROWS).select(
        "t", "k", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias(name)) for df, name in ((a, "lefts"), (b, "rights"))]
    large = blocks.written(large[0].join(large[1], ["t", "k"], "full").na.fill(1), "lsh-large-buckets")

    def sliced(df, own, mine, other, others):
        """Every row in its slice of the bucket, once for each slice of the other side."""
        df = df.join(F.broadcast(large), ["t", "k"], "left").na.fill(1, ["lefts", "rights"])
        cell = F.pmod(F.xxhash64("k"), F.lit(max(n, n_b))).cast("int")
        return df.select("item_id", "unit_vector", "t", "k", F.when(F.col("lefts") * F.col("rights") > 1, F.lit(-1) - F.xxhash64("k"))
                         .otherwise(cell).alias("cell"), F.pmod(F.xxhash64("item_id"), F.col(own)).cast("int").alias(mine),
                         F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(others))
    at = ["t", "cell", "lb", "rb"]
    a, b = sliced(a, "lefts", "lb", "rights", "rb").groupBy(*at), sliced(b, "rights", "rb", "lefts", "lb").groupBy(*at)
    pairs = a.cogroup(b).applyInArrow(_bucket_cell(cutoff), PAIR_SCHEMA)
    return pairs.groupBy("left_id", "right_id").agg(F.first("dot").alias("dot"))


def _bucket_cell(cutoff: float):
    """Pairs of one cell whose keys are equal and whose dot is over the cutoff, a matrix product for every key."""
    schema = pa.schema([("left_id", pa.int32()), ("right_id", pa.int32()), ("dot", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        flat = lambda rows, c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        (x, a), (y, b) = ((flat(t, "unit_vector"), t.column("item_id").to_numpy()) for t in (left, right))
        _, key = np.unique(np.concatenate([flat(left, "k"), flat(right, "k")]), axis=0, return_inverse=True)
        key = key.reshape(-1)
        p, q = np.argsort(key[:len(a)], kind="stable"), np.argsort(key[len(a):], kind="stable")
        kp, kq = key[:len(a)][p], key[len(a):][q]
        found = []
        for k in np.intersect1d(kp, kq):
            i = p[np.searchsorted(kp, k):np.searchsorted(kp, k, "right")]
            j = q[np.searchsorted(kq, k):np.searchsorted(kq, k, "right")]
            other, step = y[j].T, blocks.row_block(len(j), TILE)
            for lo in range(0, len(i), step):
                d = x[i[lo:lo + step]] @ other
                r, c = np.nonzero(d > cutoff)
                found.append((a[i[r + lo]], b[j[c]], d[r, c]))
        if not found:
            return schema.empty_table()
        return pa.table([np.concatenate(z) for z in zip(*found)], schema=schema)
    return run
