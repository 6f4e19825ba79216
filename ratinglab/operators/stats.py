"""Per-item rating statistics: counts, trusted items, noisy histograms, pmfs, moments.

One hash aggregate over the ratings produces everything per item (partial aggregation
runs map-side, so a hot item is pre-combined in every task before the shuffle). The
reference's ``collect_list`` of ratings per item is never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratinglab.functions.scoring import MIN_RATING, NOISE_SD, noisy_round

BUCKETS = (1, 2, 3, 4, 5)
COUNT_COLS = [f"c{k}" for k in BUCKETS]
PMF_COLS = [f"p{k}" for k in BUCKETS]


def item_counts(ratings: DataFrame) -> DataFrame:
    """A1: ``item_id, n_raw``."""
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_raw"))


def user_counts(ratings: DataFrame) -> DataFrame:
    """A3: ``user_id, n``."""
    return ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def trusted_items(ratings: DataFrame, trusted_min: int) -> DataFrame:
    """Items with strictly more than ``trusted_min`` ratings (HAVING)."""
    return item_counts(ratings).where(F.col("n_raw") > F.lit(int(trusted_min)))


def trusted_ratings(ratings: DataFrame, trusted_min: int) -> DataFrame:
    """Ratings of trusted items, as a semi-join (no columns added)."""
    return ratings.join(trusted_items(ratings, trusted_min).select("item_id"), "item_id", "left_semi")


def clean_ratings(ratings: DataFrame, min_rating: float = MIN_RATING) -> DataFrame:
    """Keep ratings >= min_rating."""
    return ratings.where(F.col("rating") >= F.lit(float(min_rating)))


def noisy_ratings(ratings: DataFrame, seed: int, noise_sd: float = NOISE_SD,
                  min_rating: float = MIN_RATING) -> DataFrame:
    """F1 on P12: ``user_id, item_id, rating, v`` with ``v = round(rating + N(0, sd))``."""
    return clean_ratings(ratings, min_rating).withColumn("v", noisy_round("rating", seed, noise_sd))


def item_histogram(ratings: DataFrame, seed: int, noise_sd: float = NOISE_SD,
                   min_rating: float = MIN_RATING) -> DataFrame:
    """A2 + F1 + F13 + P12 in one aggregate.

    ``item_id, n_raw, n_kept, c1..c5, sum_r, sum_r2``: ``n_raw`` counts every rating
    (thresholds use it), the rest use kept, noised values; a value outside 1..5 is in
    ``n_kept`` and the sums but in no bucket.
    """
    kept = F.col("rating") >= F.lit(float(min_rating))
    # the noisy value is computed once per rating in a projection, then aggregated
    noised = ratings.select("item_id", F.when(kept, noisy_round("rating", seed, noise_sd)).alias("v"))
    v = F.col("v")
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n_raw"),
        F.count(v).alias("n_kept"),
    ]
    aggs += [F.count(F.when(v == F.lit(k), F.lit(1))).alias(f"c{k}") for k in BUCKETS]
    aggs += [F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias("sum_r"),
             F.coalesce(F.sum(v * v), F.lit(0)).cast("bigint").alias("sum_r2")]
    return noised.groupBy("item_id").agg(*aggs)


def item_pmf(histogram: DataFrame) -> DataFrame:
    """A8 + U2: ``p_k = (c_k + 1) / (n_kept + 5)`` (one pseudo-count per star)."""
    denom = F.col("n_kept").cast("double") + F.lit(5.0)
    return histogram.select(
        "item_id", *[((F.col(f"c{k}") + F.lit(1)).cast("double") / denom).alias(f"p{k}") for k in BUCKETS])


def pmf_mean(prefix: str = "p") -> Column:
    return sum((F.col(f"{prefix}{k}") * F.lit(float(k)) for k in BUCKETS[1:]),
               F.col(f"{prefix}1") * F.lit(1.0))


def pmf_std(prefix: str = "p", mean: Column | None = None) -> Column:
    m = pmf_mean(prefix) if mean is None else mean
    var = sum((F.col(f"{prefix}{k}") * (F.lit(float(k)) - m) * (F.lit(float(k)) - m) for k in BUCKETS[1:]),
              F.col(f"{prefix}1") * (F.lit(1.0) - m) * (F.lit(1.0) - m))
    return F.sqrt(var)


def pmf_moments(pmf: DataFrame) -> DataFrame:
    """A10: mean and std of a pmf on stars 1..5: ``item_id, mean, std``."""
    return pmf.select("item_id", pmf_mean().alias("mean"), pmf_std().alias("std"))


def item_moments(histogram: DataFrame) -> DataFrame:
    """Mean and population std of the kept, noised ratings (NULL when none kept)."""
    n = F.col("n_kept").cast("double")
    mean = F.when(F.col("n_kept") > 0, F.col("sum_r").cast("double") / n)
    var = F.when(F.col("n_kept") > 0, F.col("sum_r2").cast("double") / n - mean * mean)
    return histogram.select("item_id", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def rated_items(ratings: DataFrame) -> DataFrame:
    """A4: distinct item ids."""
    return ratings.select("item_id").distinct()
