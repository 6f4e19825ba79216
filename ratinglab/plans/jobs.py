"""The reference's six programs as end-to-end jobs (file in, file out).

Each takes paths instead of a dataset-size flag (download and upload are not part of
the engine) and returns what it wrote, so callers can also inspect results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratinglab.functions.scoring import (B_DEFAULT, N_DEFAULT, SAMPLE_MIN, STUDY_SIZES, TRUSTED_MIN_JOB,
                                         TRUSTED_MIN_STUDY)
from ratinglab.operators import als, blocks, kernel, posterior, recommend, study
from ratinglab.sources import io


def baseline_als_job(spark: SparkSession, ratings_path: str, losses_path: str, rank: int = 6, runs: int = 1,
                     train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Plain ALS, one test MSE per run."""
    r = io.read_ratings(spark, ratings_path).cache()
    out, _ = als.als_runs(r, mode="plain", rank=rank, runs=runs, seed=seed, train_ratio=train_ratio)
    io.write_losses(out, losses_path)
    return out


def normalized_als_job(spark: SparkSession, ratings_path: str, losses_path: str, model_dir: str, rank: int = 6,
                       runs: int = 1, train_ratio: float = 0.8, seed: int = 42,
                       trusted_min: int = TRUSTED_MIN_JOB, sample_min: int = SAMPLE_MIN) -> DataFrame:
    """Item statistics -> z-scores -> ALS -> inverse -> MSE; writes the model table
    of the last run (R5, J2, F2, F4, M2, M4, J3, S4, S5)."""
    r = io.read_ratings(spark, ratings_path).cache()
    stats_df = posterior.item_stats(r, seed, trusted_min, sample_min).cache()
    out, table = als.als_runs(r, mode="normalized", rank=rank, runs=runs, seed=seed, train_ratio=train_ratio,
                              item_stats=stats_df)
    io.write_item_vectors(table, model_dir)
    io.write_losses(out, losses_path)
    return out


def sampling_study_job(spark: SparkSession, ratings_path: str, out_dir: str, seed: int = 42,
                       trusted_min: int = TRUSTED_MIN_STUDY, sizes=STUDY_SIZES, test_ratio: float = 0.1):
    """Estimator study with its five outputs."""
    r = io.read_ratings(spark, ratings_path)
    errs = study.study_errors(r, seed, trusted_min, sizes, test_ratio).cache()
    mse, its = study.study_mse(errs), study.study_iterations(errs)
    io.write_study(mse, its, out_dir)
    return mse, its


def export_vector_sets_job(spark: SparkSession, ratings_path: str, model_dir: str, output_path: str,
                           n_users: int = 100) -> DataFrame:
    """Item vectors of the most active users to the ``***`` text format.
    Raw vectors are written; the kernel side normalises them on reading."""
    r = io.read_ratings(spark, ratings_path)
    sets = kernel.vector_sets(r, io.read_item_vectors(spark, model_dir), n_users)
    io.write_vector_sets(sets, output_path)
    return sets


def kernel_fit_job(spark: SparkSession, vector_sets_path: str, out_path: str, rank: int,
                   cutoffs=(0.0, 0.1, 0.2, 0.3, 0.4, 0.5), seed: int = 42, m: int = 12) -> DataFrame:
    """Read vector sets, sweep cutoffs: fit, check, losses; write accepted kernels."""
    from pyspark.sql import functions as F
    # a set's id stands in for the user and the line position for the item
    sets = io.read_vector_sets(spark, vector_sets_path).select(
        F.col("set_id").alias("user_id"), "pos", F.col("pos").cast("int").alias("item_id"),
        "unit_vector")
    split = blocks.written(kernel.kde_split(sets, seed), "kde-split")
    sweep = kernel.kernel_sweep(split, cutoffs, rank, m)
    io.write_kernel(sweep, out_path)
    return sweep


def inference_job(spark: SparkSession, ratings_path: str, items_path: str, model_dir: str, user_ids: list[int],
                  b: float = B_DEFAULT, n: int = N_DEFAULT, rounding: str = "literal") -> DataFrame:
    """Diversified top-N for the requested users; unknown ids are an error, as in the
    reference (checked in one job, not one per user) (P13, P14, M6, M8)."""
    from pyspark.sql import functions as F
    from ratinglab.operators import users as users_op
    r = io.read_ratings(spark, ratings_path).cache()
    req = spark.createDataFrame(sorted({int(u) for u in user_ids}), "int").toDF("user_id")
    missing = sorted(row["user_id"] for row in users_op.missing_users(req, r).collect())  # at most the request list
    if missing:
        raise ValueError(f"user ids not found: {missing}")
    iv = io.read_item_vectors(spark, model_dir)
    rank = len(iv.select("item_vector").first()[0])
    return recommend.recommend(r, iv, io.read_items(spark, items_path), req, n=n, b=b, rounding=rounding,
                               rank=rank).orderBy("user_id", F.col("rank"))
