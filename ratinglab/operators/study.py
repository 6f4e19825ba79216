"""Estimator study: how well sample moments and posterior moments recover an item's
true mean and std from n draws (R2, R6, R7, F14, J8, A12, A13).

* R2: trusted items are split by a hashed uniform into priors (90%) and test pmfs.
* J8: the (size, test pmf) grid is the test pmfs exploded over the small, fixed list
  of sizes (a parameter of a handful of values, not a data-sized side).
* R6: a multinomial draw of size n is ``explode(sequence(1, n))`` with one hashed
  uniform per draw looked up in the cumulative pmf, then a count per bucket.
* R3/R4: posterior moments and expected proposals per distinct sample histogram,
  by the same grid of histogram blocks x prior blocks as ``item_stats``.

The reference runs the sampler and keeps its NaN when nothing is accepted; the closed
form is defined whenever some prior has non-zero weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratinglab.functions.rng import hash_uniform
from ratinglab.functions.scoring import (ACCEPTS, MAX_ITER, MIN_RATING, NOISE_SD, STUDY_SIZES, TRUSTED_MIN_STUDY,
                                         half_up)
from ratinglab.operators import blocks, posterior, stats

K = stats.BUCKETS


def study_pmfs(ratings: DataFrame, seed: int, trusted_min: int = TRUSTED_MIN_STUDY, test_ratio: float = 0.1,
               noise_sd: float = NOISE_SD, min_rating: float = MIN_RATING) -> DataFrame:
    """Trusted items' pmfs with ``is_test`` (R2) and true moments."""
    hist = stats.item_histogram(ratings, seed, noise_sd, min_rating)
    pmf = stats.item_pmf(hist.where(F.col("n_raw") > F.lit(int(trusted_min))))
    return pmf.select("*", (hash_uniform(seed, "items", "item_id") < F.lit(float(test_ratio))).alias("is_test"),
                      stats.pmf_mean().alias("true_mean"), stats.pmf_std().alias("true_std"))


def multinomial_counts(test_pmfs: DataFrame, sizes, seed: int) -> DataFrame:
    """R6 on J8: ``n, item_id, c1..c5`` (draw counts per star) for every size and test pmf."""
    grid = test_pmfs.select("item_id", *stats.PMF_COLS,
                            F.explode(F.array(*[F.lit(int(n)) for n in sizes])).alias("n"))
    draws = grid.select("n", "item_id", *stats.PMF_COLS, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("d"))
    u = hash_uniform(seed, "draw", "n", "item_id", "d")
    cum = []
    acc = F.col("p1")
    for k in K[:-1]:
        if k > 1:
            acc = acc + F.col(f"p{k}")
        cum.append(acc)
    bucket = F.when(u <= cum[0], 1)
    for k in K[1:-1]:
        bucket = bucket.when(u <= cum[k - 1], k)
    bucket = bucket.otherwise(5)
    b = draws.select("n", "item_id", bucket.alias("b"))
    return b.groupBy("n", "item_id").agg(*[F.count(F.when(F.col("b") == k, 1)).alias(f"c{k}") for k in K])


def study_errors(ratings: DataFrame, seed: int, trusted_min: int = TRUSTED_MIN_STUDY, sizes=STUDY_SIZES,
                 test_ratio: float = 0.1, accepts: int = ACCEPTS, max_iter: int = MAX_ITER,
                 noise_sd: float = NOISE_SD, min_rating: float = MIN_RATING) -> DataFrame:
    """R7 + F14: ``n, item_id, statistic, estimator, err, expected_proposals``."""
    pmfs = blocks.written(study_pmfs(ratings, seed, trusted_min, test_ratio, noise_sd, min_rating), "study-pmfs")
    tests = pmfs.where(F.col("is_test"))
    priors = pmfs.where(~F.col("is_test")).select(
        F.col("item_id").alias("prior_id"), *stats.PMF_COLS,
        F.col("true_mean").alias("mean_q"), F.col("true_std").alias("std_q"))
    counts = blocks.written(multinomial_counts(tests, sizes, seed), "study-counts")
    post = posterior.posterior_moments(counts, priors, accepts, max_iter)
    n = F.col("n").cast("double")
    sample_mean = sum((F.col(f"c{k}") * F.lit(k) for k in K[1:]), F.col("c1")).cast("double") / n
    phat_mean = sum((F.col(f"c{k}") / n * F.lit(float(k)) for k in K[1:]), F.col("c1") / n * F.lit(1.0))
    sample_std = F.sqrt(sum((F.col(f"c{k}") / n * (F.lit(float(k)) - phat_mean) * (F.lit(float(k)) - phat_mean)
                             for k in K[1:]), F.col("c1") / n * (F.lit(1.0) - phat_mean) * (F.lit(1.0) - phat_mean)))
    j = (counts.join(tests.select("item_id", "true_mean", "true_std"), "item_id")
         .join((post.select(*stats.COUNT_COLS, F.col("mean").alias("post_mean"),
                                       F.col("std").alias("post_std"), "expected_proposals")),
               stats.COUNT_COLS, "left"))
    errs = j.select(
        "n", "item_id", "expected_proposals",
        F.explode(F.array(
            F.struct(F.lit("mean").alias("statistic"), F.lit("sample").alias("estimator"),
                     (sample_mean - F.col("true_mean")).alias("err")),
            F.struct(F.lit("mean").alias("statistic"), F.lit("posterior").alias("estimator"),
                     (F.col("post_mean") - F.col("true_mean")).alias("err")),
            F.struct(F.lit("std").alias("statistic"), F.lit("sample").alias("estimator"),
                     (sample_std - F.col("true_std")).alias("err")),
            F.struct(F.lit("std").alias("statistic"), F.lit("posterior").alias("estimator"),
                     (F.col("post_std") - F.col("true_std")).alias("err")),
        )).alias("e"))
    return errs.select("n", "item_id", "e.statistic", "e.estimator", "e.err", "expected_proposals")


def study_mse(errors: DataFrame) -> DataFrame:
    """``n, statistic, estimator, mse``."""
    return errors.groupBy("n", "statistic", "estimator").agg(F.avg(F.col("err") * F.col("err")).alias("mse"))


def study_iterations(errors: DataFrame) -> DataFrame:
    """``n, avg_proposals, avg_proposals_rounded`` (the reference writes the rounded int)."""
    one = errors.where((F.col("statistic") == "mean") & (F.col("estimator") == "sample"))
    a = one.groupBy("n").agg(F.avg("expected_proposals").alias("avg_proposals"))
    return a.select("n", "avg_proposals", half_up(F.col("avg_proposals")).alias("avg_proposals_rounded"))
