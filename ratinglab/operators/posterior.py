"""Posterior item moments.

The reference draws priors uniformly and accepts a draw with probability
``exp(alpha)``, ``alpha = sum_i s_i * ln(q_i * n / s_i)`` (= -n * KL(s/n || q) <= 0),
stopping at 100 accepts. Accepted pmfs are therefore draws from the posterior with
weights ``w_q = exp(alpha_q)``; the averaged moments converge to
``sum w*m / sum w`` and the expected number of proposals is ``accepts / avg(w)``.
We compute that closed form exactly.

Physical plan: cold items are reduced to their *distinct* histograms and priors to their
*distinct* pmfs with multiplicities. Both sides are hashed to blocks; one cogrouped step per
(histogram block, prior block) computes ``alpha = S @ ln(Q).T + const`` and returns one row of
partial sums per histogram, which a ``groupBy`` adds. A task holds one block of each side; the
driver sees row counts only.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratinglab.functions.rng import hash_uniform
from ratinglab.functions.scoring import ACCEPTS, MAX_ITER, MIN_RATING, NOISE_SD, SAMPLE_MIN, TRUSTED_MIN_JOB
from ratinglab.operators import blocks, stats
from ratinglab.session import ship_package

HIST = stats.COUNT_COLS
SUMS = ("sum_w", "sum_wm", "sum_ws")
#: Rows of a histogram block and of a prior block, and the fewest histograms that are worth one.
HIST_ROWS, PRIOR_ROWS, SMALL_HIST = 1 << 12, 1 << 14, 1 << 6
#: Elements of the weight matrix a cell works on at once.
TILE = 1 << 18

_SUMS = ", ".join([f"{c} bigint" for c in HIST] + [f"{c} double" for c in SUMS] + ["n_q bigint"])
_SUMS_ARROW = pa.schema([(c, pa.int64()) for c in HIST] + [(c, pa.float64()) for c in SUMS] + [("n_q", pa.int64())])


def priors_table(histogram: DataFrame, trusted_min: int) -> DataFrame:
    """Trusted items' pmfs with their moments: ``prior_id, p1..p5, mean_q, std_q``."""
    trusted = histogram.where(F.col("n_raw") > F.lit(int(trusted_min)))
    pmf = stats.item_pmf(trusted)
    return pmf.select(F.col("item_id").alias("prior_id"), *stats.PMF_COLS,
                      stats.pmf_mean().alias("mean_q"), stats.pmf_std().alias("std_q"))


def _alpha_const(h: np.ndarray) -> np.ndarray:
    """n*ln(n) - sum s_i*ln(s_i) per histogram row (0*ln 0 = 0)."""
    n = h.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        nl = np.where(n > 0, n * np.log(np.where(n > 0, n, 1)), 0.0)
        sl = np.where(h > 0, h * np.log(np.where(h > 0, h, 1)), 0.0).sum(axis=1)
    return nl - sl


def _columns(table: pa.Table, names) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1).astype(np.float64)


def _weights(h: np.ndarray, log_q: np.ndarray):
    """(histogram range, matrix of exp(alpha)) in runs that fit a tile."""
    const = _alpha_const(h)
    step = blocks.row_block(len(log_q), TILE)
    for lo in range(0, len(h), step):
        hi = min(len(h), lo + step)
        yield slice(lo, hi), np.exp(h[lo:hi] @ log_q.T + const[lo:hi, None])


def _sums_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial sums of every histogram of the block over the block's priors."""
    if not len(left) or not len(right):
        return _SUMS_ARROW.empty_table()
    h, times = _columns(left, HIST), right.column("times").to_numpy().astype(np.float64)
    log_q = np.log(_columns(right, stats.PMF_COLS))
    terms = _columns(right, ("mean_q", "std_q")) * times[:, None]
    terms = np.concatenate([times[:, None], terms], axis=1)
    sums = np.empty((len(h), 3))
    for rows, w in _weights(h, log_q):
        sums[rows] = w @ terms
    return pa.table([left.column(c) for c in HIST] + [pa.array(sums[:, j]) for j in range(3)]
                    + [pa.array(np.full(len(h), int(times.sum())))], schema=_SUMS_ARROW)


def posterior_sums(cold_histograms: DataFrame, priors: DataFrame) -> DataFrame:
    """Per distinct histogram ``c1..c5``: ``sum_w, sum_wm, sum_ws, n_q`` over all priors."""
    spark = priors.sparkSession
    ship_package(spark)
    h = blocks.written(cold_histograms.select(*HIST).distinct(), "histograms")
    q = blocks.written(priors.groupBy(*stats.PMF_COLS, "mean_q", "std_q").agg(F.count(F.lit(1)).alias("times")), "priors")
    n_q = max(1, -(-q.count() // PRIOR_ROWS))
    n_h = blocks.block_count(spark, h.count(), HIST_ROWS, SMALL_HIST, n_q)
    partial = blocks.grid(h, q, blocks.hashed(n_h, *HIST), blocks.hashed(n_q, *stats.PMF_COLS), n_h, n_q, _sums_cell, _SUMS)
    return partial.groupBy(*HIST).agg(*[F.sum(c).alias(c) for c in (*SUMS, "n_q")])


def posterior_moments(cold_histograms: DataFrame, priors: DataFrame, accepts: int = ACCEPTS,
                      max_iter: int = MAX_ITER) -> DataFrame:
    """Closed-form posterior per distinct histogram:
    ``c1..c5, mean, std, avg_w, expected_proposals, n_q``."""
    s = posterior_sums(cold_histograms, priors)
    avg_w = F.col("sum_w") / F.col("n_q")
    ok = F.col("sum_w") > 0
    return s.select(
        *HIST,
        F.when(ok, F.col("sum_wm") / F.col("sum_w")).alias("mean"),
        F.when(ok, F.col("sum_ws") / F.col("sum_w")).alias("std"),
        avg_w.alias("avg_w"),
        F.when(ok, F.least(F.lit(float(accepts)) / avg_w, F.lit(float(max_iter))))
        .otherwise(F.lit(float(max_iter))).alias("expected_proposals"),
        "n_q")


def item_stats(ratings: DataFrame, seed: int, trusted_min: int = TRUSTED_MIN_JOB,
               sample_min: int = SAMPLE_MIN, accepts: int = ACCEPTS, max_iter: int = MAX_ITER,
               noise_sd: float = NOISE_SD, min_rating: float = MIN_RATING) -> DataFrame:
    """``item_id, mean, std, source`` with source in plain / posterior / fallback.

    * plain: ``n_raw >= sample_min`` and some rating kept: sample mean, population std.
    * posterior: otherwise, when the sampler would accept at all
      (``avg_w * max_iter >= 1``); an empty histogram gives the prior average;
      a posterior std of 0 becomes 1e-9.
    * fallback: sample moments of the kept ratings.
    """
    hist = blocks.written(stats.item_histogram(ratings, seed, noise_sd, min_rating), "item-histogram")
    priors = priors_table(hist, trusted_min)
    cold_flag = (F.col("n_raw") < F.lit(int(sample_min))) | (F.col("n_kept") == 0)
    cold = hist.where(cold_flag)
    post = posterior_moments(cold, priors, accepts, max_iter)
    joined = hist.join((post.select(*HIST, F.col("mean").alias("post_mean"),
                                               F.col("std").alias("post_std"), "avg_w")),
                       HIST, "left")
    n = F.col("n_kept").cast("double")
    s_mean = F.when(F.col("n_kept") > 0, F.col("sum_r").cast("double") / n)
    s_var = F.when(F.col("n_kept") > 0, F.col("sum_r2").cast("double") / n - s_mean * s_mean)
    j = joined.withColumn("s_mean", s_mean).withColumn("s_std", F.sqrt(F.greatest(s_var, F.lit(0.0))))
    use_post = cold_flag & F.col("avg_w").isNotNull() & (F.col("avg_w") * F.lit(float(max_iter)) >= 1.0) \
        & F.col("post_mean").isNotNull()
    source = F.when(~cold_flag, F.lit("plain")).when(use_post, F.lit("posterior")).otherwise(F.lit("fallback"))
    mean = F.when(use_post, F.col("post_mean")).otherwise(F.col("s_mean"))
    std = F.when(use_post, F.when(F.col("post_std") == 0, F.lit(1e-9)).otherwise(F.col("post_std"))) \
        .otherwise(F.col("s_std"))
    return j.select("item_id", mean.alias("mean"), std.alias("std"), source.alias("source"))


def expected_proposals(cold_histograms: DataFrame, priors: DataFrame, accepts: int = ACCEPTS,
                       max_iter: int = MAX_ITER) -> DataFrame:
    """R4 per distinct histogram."""
    return posterior_moments(cold_histograms, priors, accepts, max_iter).select(*HIST, "expected_proposals")


# ------------------------------------------------------------------ sampled posterior (R3, sampled form)

_BUCKET_SUMS = ", ".join(["b int"] + [f"{c} bigint" for c in HIST] + ["t double"])
_BUCKET_ARROW = pa.schema([("b", pa.int32())] + [(c, pa.int64()) for c in HIST] + [("t", pa.float64())])
_DRAWN = T.StructType([T.StructField("item_id", T.IntegerType()), T.StructField("draw", T.IntegerType()),
                       T.StructField("prior_id", T.IntegerType())])
#: Priors of a bucket; draws of one histogram or one bucket that share a task.
BUCKET_ROWS, DRAW_ROWS = 1 << 14, 1 << 20


def _bucket_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """Weight total of one bucket of priors for every histogram of the block."""
    if not len(left) or not len(right):
        return _BUCKET_ARROW.empty_table()
    h, log_q = _columns(left, HIST), np.log(_columns(right, stats.PMF_COLS))
    total = np.empty(len(h))
    for rows, w in _weights(h, log_q):
        total[rows] = w.sum(axis=1)
    b = np.full(len(h), right.column("rb")[0].as_py())
    return pa.table([pa.array(b, pa.int32())] + [left.column(c) for c in HIST] + [pa.array(total)], schema=_BUCKET_ARROW)


def _resolve_in_bucket(priors: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
    """Inverse CDF inside one bucket (or one salt slice of it): priors sorted by id,
    one weight matrix for all histograms present, one ``searchsorted`` per histogram."""
    if len(draws) == 0 or len(priors) == 0:
        return pd.DataFrame({"item_id": [], "draw": [], "prior_id": []})
    priors = priors.sort_values("prior_id")
    log_q = np.log(priors[stats.PMF_COLS].to_numpy(dtype=np.float64))
    ids = priors["prior_id"].to_numpy()
    hists, inv = np.unique(draws[HIST].to_numpy(dtype=np.float64), axis=0, return_inverse=True)
    inv = inv.reshape(-1)
    t_local = draws["t_local"].to_numpy()
    pick = np.empty(len(draws), dtype=np.int64)
    order = np.argsort(inv, kind="stable")
    bounds = np.searchsorted(inv[order], np.arange(len(hists) + 1))
    for some, w in _weights(hists, log_q):
        cum = np.cumsum(w, axis=1)
        for j in range(some.start, some.stop):
            rows = order[bounds[j]:bounds[j + 1]]
            pick[rows] = np.minimum(np.searchsorted(cum[j - some.start], t_local[rows], side="right"), len(ids) - 1)
    return pd.DataFrame({"item_id": draws["item_id"].to_numpy(), "draw": draws["draw"].to_numpy(),
                         "prior_id": ids[pick]})


def prior_buckets(priors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Priors with a bucket ``b`` of about ``rows`` of them, buckets ascending in ``prior_id``: cut at
    quantiles, so clustered ids do not crowd one bucket. Written, so that the cut stays as it is."""
    n = max(1, -(-priors.count() // rows))
    cut = priors.select("prior_id", *stats.PMF_COLS).repartitionByRange(n, "prior_id").withColumn("b", F.spark_partition_id())
    return blocks.written(cut, "prior-buckets"), n


def posterior_sample(cold_items: DataFrame, priors: DataFrame, seed: int, accepts: int = ACCEPTS,
                     max_draws_per_group: int = DRAW_ROWS, priors_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """R3, sampled: ``item_id, draw, prior_id`` with ``accepts`` draws per cold item from
    its posterior over priors (weights ``exp(alpha)``), by inverse CDF over priors in
    ``prior_id`` order with the hashed uniform ``u(seed, 'post', item_id, draw)``.

    ``cold_items`` carries ``item_id, c1..c5``. Every piece is bounded:

    1. priors get count-balanced buckets; the grid of histogram blocks x buckets gives each bucket's
       weight total per distinct histogram;
    2. a draw finds its bucket by an as-of lookup: draws (at ``u``) and the buckets' cumulative shares
       of their histogram are sorted together, and each draw takes the last share before it. A
       histogram's draws are salted into slices of ``max_draws_per_group`` (the shares are copied), so
       a histogram that most items have is spread over tasks;
    3. per bucket, a cogrouped step finds the prior; a bucket's draws are salted in the same way (its
       priors are copied), so one dominant prior cannot pull every draw into one task."""
    spark = priors.sparkSession
    ship_package(spark)
    qb, n_b = prior_buckets(priors, priors_per_bucket)
    items = cold_items.select("item_id", *HIST)
    h = blocks.written(items.groupBy(*HIST).agg(F.count(F.lit(1)).alias("n_items")), "sampled-histograms")
    n_h = blocks.block_count(spark, h.count(), HIST_ROWS, SMALL_HIST, n_b)
    tot = blocks.grid(h.select(*HIST), qb, blocks.hashed(n_h, *HIST), F.col("b"), n_h, n_b, _bucket_cell, _BUCKET_SUMS)
    w = Window.partitionBy(*HIST)
    shares = tot.where("t > 0").select("*", F.sum("t").over(w).alias("total"), F.coalesce(
        F.sum("t").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("lo"))
    salts = h.select(*HIST, F.greatest(F.lit(1), F.ceil(F.col("n_items") * accepts / F.lit(max_draws_per_group))).cast("int").alias("salts"))
    draws = (items.join(salts, HIST).select("*", F.explode(F.sequence(F.lit(1), F.lit(int(accepts)))).alias("draw"))
             .select(*HIST, F.pmod(F.xxhash64("item_id", "draw"), F.col("salts")).cast("int").alias("salt"),
                     hash_uniform(seed, "post", "item_id", "draw").alias("at"), F.lit(None).cast(
                         "struct<b:int,lo:double,total:double>").alias("share"), "item_id", "draw"))
    starts = shares.join(salts, HIST).select(
        *HIST, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), (F.col("lo") / F.col("total")).alias("at"),
        F.struct("b", "lo", "total").alias("share"), F.lit(None).cast("int").alias("item_id"), F.lit(None).cast("int").alias("draw"))
    before = Window.partitionBy(*HIST, "salt").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = (starts.unionByName(draws).withColumn("share", F.last("share", ignorenulls=True).over(before))
             .where("item_id IS NOT NULL AND share IS NOT NULL"))
    d = blocks.written(found.select(
        "item_id", "draw", *HIST, F.col("share.b").alias("b"),
        F.greatest(F.col("at") * F.col("share.total") - F.col("share.lo"), F.lit(0.0)).alias("t_local")), "posterior-draws")
    per_b = d.groupBy("b").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(max_draws_per_group))).cast("int").alias("salts"))
    d = (d.join(per_b, "b")
         .withColumn("salt", F.pmod(F.xxhash64("item_id", "draw"), F.col("salts")).cast("int"))
         .select("b", "salt", "item_id", "draw", *HIST, "t_local"))
    qs = qb.join(per_b.withColumnRenamed("b", "of"), F.col("b") == F.col("of")).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "prior_id", *stats.PMF_COLS)
    return qs.groupBy("b", "salt").cogroup(d.groupBy("b", "salt")).applyInPandas(_resolve_in_bucket, _DRAWN)


def sampled_moments(samples: DataFrame, priors: DataFrame) -> DataFrame:
    """Average prior moments over the drawn priors: ``item_id, mean, std``."""
    m = priors.select("prior_id", "mean_q", "std_q")
    return samples.join(m, "prior_id").groupBy("item_id").agg(F.avg("mean_q").alias("mean"),
                                                              F.avg("std_q").alias("std"))
