"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one reads the driver's tables (through ``sources.fixtures``) in full; float
outputs are rounded to 6 decimals so that sums in a different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratinglab.operators import als, blocks, normalize, posterior, recommend, kernel, similarity, splits, stats, study, users
from ratinglab.plans import params as P
from ratinglab.session import scratch_path
from ratinglab.sources import fixtures as fx
from ratinglab.sources import io

Query = Callable[[SparkSession, str], DataFrame]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _hist(spark, sf):
    return stats.item_histogram(fx.ratings(spark, sf), P.SEED, P.NOISE_SD, P.MIN_RATING)


def q_item_vectors(spark, sf):
    iv = fx.item_vectors(spark, sf)
    return iv.select("item_id", F.transform("item_vector", lambda x: F.round(x, 6)).alias("item_vector"),
                     r6("mean").alias("mean"), r6("std").alias("std"))


def q_pmf_moments(spark, sf):
    m = stats.pmf_moments(stats.item_pmf(_hist(spark, sf)))
    return m.select("item_id", r6("mean").alias("mean"), r6("std").alias("std"))


def q_item_moments(spark, sf):
    m = stats.item_moments(_hist(spark, sf))
    return m.select("item_id", r6("mean").alias("mean"), r6("std").alias("std"))


def stats_queries() -> dict[str, Query]:
    return {
        "ratings": lambda s, d: fx.ratings(s, d),
        "items": lambda s, d: fx.items(s, d),
        "item_vectors": q_item_vectors,
        "item_counts": lambda s, d: stats.item_counts(fx.ratings(s, d)),
        "user_counts": lambda s, d: stats.user_counts(fx.ratings(s, d)),
        "trusted_items": lambda s, d: stats.trusted_items(fx.ratings(s, d), P.TRUSTED_MIN),
        "trusted_ratings": lambda s, d: stats.trusted_ratings(fx.ratings(s, d), P.TRUSTED_MIN),
        "clean_ratings": lambda s, d: stats.clean_ratings(fx.ratings(s, d), P.MIN_RATING),
        "noisy_ratings": lambda s, d: stats.noisy_ratings(fx.ratings(s, d), P.SEED, P.NOISE_SD, P.MIN_RATING)
        .select("user_id", "item_id", "rating", "v"),
        "item_histogram": _hist,
        "item_pmf": lambda s, d: stats.item_pmf(_hist(s, d)),
        "pmf_moments": q_pmf_moments,
        "item_moments": q_item_moments,
        "rated_items": lambda s, d: stats.rated_items(fx.ratings(s, d)),
        "hash_split": lambda s, d: splits.hash_split(fx.ratings(s, d), P.TRAIN_RATIO, P.SEED)
        .select("user_id", "item_id", "rating", "is_train"),
    }


def q_posterior_moments(spark, sf):
    cold, priors = _cold_and_priors(spark, sf)
    pm = posterior.posterior_moments(cold, priors, P.ACCEPTS, P.MAX_ITER)
    return pm.select(*stats.COUNT_COLS, r6("mean").alias("mean"), r6("std").alias("std"),
                     r6("expected_proposals").alias("expected_proposals"), "n_q")


def q_item_stats(spark, sf):
    st = posterior.item_stats(fx.ratings(spark, sf), P.SEED, P.TRUSTED_MIN, P.SAMPLE_MIN, P.ACCEPTS, P.MAX_ITER,
                              P.NOISE_SD, P.MIN_RATING)
    return st.select("item_id", r6("mean").alias("mean"), r6("std").alias("std"), "source")


def _cold_and_priors(spark, sf):
    hist = blocks.written(_hist(spark, sf), "item-histogram")
    priors = posterior.priors_table(hist, P.TRUSTED_MIN)
    return hist.where((F.col("n_raw") < P.SAMPLE_MIN) | (F.col("n_kept") == 0)), priors


def q_posterior_weights(spark, sf):
    cold, priors = _cold_and_priors(spark, sf)
    w = posterior.posterior_sums(cold, priors)
    return w.select(*stats.COUNT_COLS, r6("sum_w").alias("sum_w"), r6("sum_wm").alias("sum_wm"),
                    r6("sum_ws").alias("sum_ws"), "n_q")


def q_expected_proposals(spark, sf):
    cold, priors = _cold_and_priors(spark, sf)
    e = posterior.expected_proposals(cold, priors, P.ACCEPTS, P.MAX_ITER)
    return e.select(*stats.COUNT_COLS, r6("expected_proposals").alias("expected_proposals"))


def q_posterior_sample(spark, sf):
    cold, priors = _cold_and_priors(spark, sf)
    return posterior.posterior_sample(cold.select("item_id", *stats.COUNT_COLS), priors, P.SEED, P.ACCEPTS)


def posterior_queries() -> dict[str, Query]:
    return {"posterior_moments": q_posterior_moments, "item_stats": q_item_stats,
            "posterior_sample": q_posterior_sample,
            "posterior_weights": q_posterior_weights, "expected_proposals": q_expected_proposals}


def _vec_inputs(spark, sf, rank=P.RANK):
    r = fx.ratings(spark, sf).cache()
    return r, fx.item_vectors(spark, sf, rank, r).cache()


def _rated(spark, sf):
    """Ratings without their times, written and not cached: executors keep room, and the shuffles behind them go."""
    return blocks.written(fx.ratings(spark, sf).select("user_id", "item_id", "rating"), "ratings", free=True)


def _grid_inputs(spark, sf):
    """As ``_vec_inputs``, for queries over the users x items grid."""
    r = _rated(spark, sf)
    return r, blocks.written(fx.item_vectors(spark, sf, P.RANK, r), "item-vectors", free=True)


def q_ratings_with_vectors(spark, sf):
    r, iv = _vec_inputs(spark, sf, None)
    j = similarity.ratings_with_vectors(r, iv)
    return j.select("user_id", "item_id", "rating", F.transform("item_vector", lambda x: F.round(x, 6))
                    .alias("item_vector"), r6("mean").alias("mean"), r6("std").alias("std"))


def q_similar_items_exact(spark, sf):
    _, iv = _vec_inputs(spark, sf, None)
    unit = similarity.normalized_vectors(iv)
    pairs = similarity.similar_items_exact(unit, None, 0.4, strict=True)
    return pairs.select("left_id", "right_id", r6("dot").alias("dot"))


def q_similar_items_lsh(spark, sf):
    _, iv = _vec_inputs(spark, sf, None)
    unit = similarity.normalized_vectors(iv)
    pairs = similarity.similar_items_keys(unit, unit, P.CUTOFF, fx.EMBEDDING_DIM, P.LSH_TABLES, P.LSH_WIDTH)
    return pairs.select("left_id", "right_id", r6("dot").alias("dot"))


def _zrv(spark, sf):
    r, iv = _vec_inputs(spark, sf)
    return users.zscored_with_vectors(similarity.ratings_with_vectors(r, iv))


def q_user_gram(spark, sf):
    g = users.user_gram(_zrv(spark, sf), P.RANK)
    rnd = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return g.select("user_id", "n", rnd("xtx").alias("xtx"), rnd("xty").alias("xty"), rnd("sx").alias("sx"),
                    r6("sy").alias("sy"), r6("syy").alias("syy"))


def q_user_vectors(spark, sf):
    v = users.user_vectors(users.user_gram(_zrv(spark, sf), P.RANK), P.RANK, P.RIDGE_REG)
    return v.select("user_id", F.transform("user_vector", lambda x: F.round(x, 6)).alias("user_vector"),
                    "degenerate")


def q_user_item_pdf(spark, sf):
    r, iv = _grid_inputs(spark, sf)
    return recommend.user_item_pdf(r, iv, 0.4).select("user_id", "item_id", r6("pdf").alias("pdf"))


def q_score_candidates(spark, sf):
    """Every unseen item of every user, those without a similar rated item (pdf 0) included."""
    r, iv = _grid_inputs(spark, sf)
    known = r.where("user_id IS NOT NULL")  # a null user has no candidates, and its vector would come as user 0's
    uv = users.user_vectors_from_ratings(similarity.ratings_with_vectors(known, iv), P.RANK, P.RIDGE_REG)
    cands = recommend.user_item_pdf(r, iv, 0.4, user_vecs=uv)
    sc = recommend.score_candidates(cands, uv, iv, P.B, 1e-5, "literal")
    return sc.select("user_id", "item_id", "predicted", r6("pdf").alias("pdf"), r6("score").alias("score"))


def q_candidate_totals(spark, sf):
    """Per user, over every unseen item, those without a similar rated item included."""
    r, iv = _grid_inputs(spark, sf)
    t = recommend.candidate_totals(r, iv, P.B, 1e-5, 0.4, rounding="literal", rank=P.RANK, reg=P.RIDGE_REG)
    return t.select("user_id", "n_candidates", "n_zero", r6("pdf_sum").alias("pdf_sum"), r6("best_score").alias("best_score"))


def q_candidate_report(spark, sf):
    """Best candidates of every user beside the totals over the whole grid."""
    r, iv = _grid_inputs(spark, sf)
    t = recommend.candidate_report(r, iv, P.N_PICKS, P.B, 1e-5, 0.4, rounding="literal", rank=P.RANK, reg=P.RIDGE_REG)
    return t.select("user_id", "rank", "item_id", "predicted", r6("pdf").alias("pdf"), r6("score").alias("score"),
                    "n_candidates", "n_zero", r6("pdf_sum").alias("pdf_sum"))


def _q_recommend(rounding):
    def run(spark, sf):
        r, iv = _grid_inputs(spark, sf)
        rec = recommend.recommend(r, iv, fx.items(spark, sf), None, n=P.N_PICKS, b=P.B, rounding=rounding,
                                  rank=P.RANK, reg=P.RIDGE_REG)
        return rec.select("user_id", "rank", "item_id", "title", r6("score").alias("score"))
    return run


def q_missing_users(spark, sf):
    """Customers (as a request list) without any rated item that has a vector."""
    customers = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("user_id"))
    r, iv = _vec_inputs(spark, sf, None)
    return users.missing_users(customers, similarity.ratings_with_vectors(r, iv))


def q_recommend_requested(spark, sf):
    """Recommendations for a request list: the customers of one market segment."""
    r, iv = _grid_inputs(spark, sf)
    want = fx.table(spark, sf, "customer").where(F.col("c_mktsegment") == P.SEGMENT).select(
        F.col("c_custkey").cast("int").alias("user_id"))
    rec = recommend.recommend(r, iv, fx.items(spark, sf), want, n=P.N_PICKS, b=P.B, rounding="literal",
                              rank=P.RANK, reg=P.RIDGE_REG)
    return rec.select("user_id", "rank", "item_id", "title", r6("score").alias("score"))


def _zscored(spark, sf):
    r = fx.ratings(spark, sf).cache()
    st = posterior.item_stats(r, P.SEED, P.TRUSTED_MIN, P.SAMPLE_MIN, P.ACCEPTS, P.MAX_ITER, P.NOISE_SD,
                              P.MIN_RATING)
    return normalize.zscore_ratings(r, st)


def q_zscore_ratings(spark, sf):
    z = _zscored(spark, sf)
    return z.select("user_id", "item_id", "rating", r6("z").alias("z"), r6("mean").alias("mean"),
                    r6("std").alias("std"))


def q_zscore_mse(spark, sf):
    z = splits.hash_split(_zscored(spark, sf), P.TRAIN_RATIO, P.SEED)
    pred = normalize.inverse_predictions(normalize.user_mean_z_predictions(z))
    m = normalize.mse(pred, "rating", "raw_prediction")
    return m.select(r6("mse").alias("mse"), "n_scored")


def _q_als(mode):
    def run(spark, sf):
        r, st = fx.ratings(spark, sf), None
        if mode == "normalized":
            r = _rated(spark, sf)
            st = posterior.item_stats(r, P.SEED, P.TRUSTED_MIN, P.SAMPLE_MIN, P.ACCEPTS, P.MAX_ITER, P.NOISE_SD,
                                      P.MIN_RATING)
        runs, _ = als.als_runs(r, mode=mode, rank=P.RANK, max_iter=P.ALS_ITERATIONS, runs=1, seed=P.SEED,
                               train_ratio=P.TRAIN_RATIO, item_stats=st,
                               num_blocks=P.ALS_BLOCKS, item_blocks=P.ALS_ITEM_BLOCKS)
        return runs
    return run


def q_als_cold_start(spark, sf):
    """Scored test rows of two runs: those whose user and item are in the run's training rows."""
    runs, _ = als.als_runs(fx.ratings(spark, sf), mode="plain", rank=P.RANK, max_iter=P.ALS_ITERATIONS, runs=2, seed=P.SEED,
                           train_ratio=P.TRAIN_RATIO, num_blocks=P.ALS_BLOCKS, item_blocks=P.ALS_ITEM_BLOCKS)
    return runs.select("run", "n_test", "n_scored")


def q_als_model_table(spark, sf):
    """The trained model table: every training item with its statistics and vector length."""
    r = _rated(spark, sf)
    st = posterior.item_stats(r, P.SEED, P.TRUSTED_MIN, P.SAMPLE_MIN, P.ACCEPTS, P.MAX_ITER, P.NOISE_SD, P.MIN_RATING)
    _, model = als.als_runs(r, mode="normalized", rank=P.RANK, max_iter=P.ALS_ITERATIONS, runs=1, seed=P.SEED,
                            train_ratio=P.TRAIN_RATIO, item_stats=st, num_blocks=P.ALS_BLOCKS, item_blocks=P.ALS_ITEM_BLOCKS)
    return model.select("item_id", F.size("item_vector").alias("n_components"), r6("mean").alias("mean"), r6("std").alias("std"))


def q_als_sweep(spark, sf):
    """User and item factors after two full sweeps from hashed start factors."""
    users_, items_ = als.als_sweeps(fx.ratings(spark, sf), P.RANK, P.ALS_REG, P.ALS_SWEEPS, P.SEED)

    def side(df, name):
        return df.select(F.lit(name).alias("side"), "id", F.array(*[r6(f"x{i}") for i in range(P.RANK)]).alias("factors"))
    return side(users_, "user").unionByName(side(items_, "item"))


def vector_queries() -> dict[str, Query]:
    return {
        "ratings_with_vectors": q_ratings_with_vectors,
        "similar_items_exact": q_similar_items_exact,
        "similar_items_lsh": q_similar_items_lsh,
        "user_gram": q_user_gram,
        "user_vectors": q_user_vectors,
        "user_item_pdf": q_user_item_pdf,
        "score_candidates": q_score_candidates,
        "candidate_totals": q_candidate_totals,
        "candidate_report": q_candidate_report,
        "recommend": _q_recommend("literal"),
        "recommend_half_star": _q_recommend("half_star"),
        "recommend_requested": q_recommend_requested,
        "missing_users": q_missing_users,
        "zscore_ratings": q_zscore_ratings,
        "zscore_mse": q_zscore_mse,
        "als_plain": _q_als("plain"),
        "als_normalized": _q_als("normalized"),
        "als_sweep": q_als_sweep,
        "als_cold_start": q_als_cold_start,
        "als_model_table": q_als_model_table,
    }


def _study_errors(spark, sf):
    return study.study_errors(fx.ratings(spark, sf), P.SEED, P.TRUSTED_MIN, P.STUDY_SIZES, P.TEST_RATIO,
                              P.ACCEPTS, P.MAX_ITER, P.NOISE_SD, P.MIN_RATING)


def q_multinomial_counts(spark, sf):
    pm = study.study_pmfs(fx.ratings(spark, sf), P.SEED, P.TRUSTED_MIN, P.TEST_RATIO, P.NOISE_SD, P.MIN_RATING)
    return study.multinomial_counts(pm.where(F.col("is_test")), P.STUDY_SIZES, P.SEED)


def q_study_errors(spark, sf):
    e = _study_errors(spark, sf)
    return e.select("n", "item_id", "statistic", "estimator", r6("err").alias("err"),
                    r6("expected_proposals").alias("expected_proposals"))


def q_study_mse(spark, sf):
    return study.study_mse(_study_errors(spark, sf)).select("n", "statistic", "estimator", r6("mse").alias("mse"))


def q_study_iterations(spark, sf):
    it = study.study_iterations(_study_errors(spark, sf))
    return it.select("n", r6("avg_proposals").alias("avg_proposals"), "avg_proposals_rounded")


def study_queries() -> dict[str, Query]:
    return {"multinomial_counts": q_multinomial_counts, "study_errors": q_study_errors,
            "study_mse": q_study_mse, "study_iterations": q_study_iterations}


def _split(spark, sf):
    r, iv = _vec_inputs(spark, sf)
    return blocks.written(kernel.kde_split(kernel.vector_sets(r, iv, P.N_USERS), P.SEED), "kde-split")


def q_top_users(spark, sf):
    return kernel.top_users(fx.ratings(spark, sf), P.N_USERS)


def q_vector_sets(spark, sf):
    r, iv = _vec_inputs(spark, sf, None)
    vs = kernel.vector_sets(r, iv, P.N_USERS)
    return vs.select("user_id", "pos", "item_id",
                     F.transform("unit_vector", lambda x: F.round(x, 6)).alias("unit_vector"))


def q_kernel_features(spark, sf):
    f = kernel.kernel_features(_split(spark, sf), P.KDE_CUTOFFS, 5)
    return f.select("user_id", "item_id", "cutoff", "k", r6("phi").alias("phi"))


def q_kde_nll(spark, sf):
    from ratinglab.functions.scoring import INFERENCE_KERNEL
    n = kernel.kde_nll(_split(spark, sf), [(c, INFERENCE_KERNEL) for c in P.KDE_CUTOFFS], users="test")
    return n.select("cutoff", r6("nll").alias("nll"))


def q_kernel_em_step(spark, sf):
    """Weights and objective of two EM steps at every cutoff."""
    e = kernel.em_steps(_split(spark, sf), P.KDE_CUTOFFS, P.RANK, P.EM_BASES, 2)
    return e.select("step", "cutoff", F.transform("weights", lambda x: F.round(x, 6)).alias("weights"), r6("objective").alias("objective"))


def q_kernel_sweep(spark, sf):
    """The sweep in the reference's own family of kernels."""
    return kernel.polynomial_sweep(_split(spark, sf), P.KDE_CUTOFFS, P.RANK)


def kernel_queries() -> dict[str, Query]:
    return {"top_users": q_top_users, "vector_sets": q_vector_sets, "kernel_features": q_kernel_features,
            "kde_nll": q_kde_nll, "kernel_em_step": q_kernel_em_step, "kernel_sweep": q_kernel_sweep}


def q_read_ratings(spark, sf):
    path = scratch_path(spark, "ratings-csv")
    io.write_ratings(fx.ratings(spark, sf), path)
    return io.read_ratings(spark, path)


def q_read_items(spark, sf):
    path = scratch_path(spark, "items-csv")
    io.write_items(fx.items(spark, sf), path)
    return io.read_items(spark, path)


def q_read_item_vectors(spark, sf):
    path = scratch_path(spark, "model")
    io.write_item_vectors(fx.item_vectors(spark, sf), path)
    iv = io.read_item_vectors(spark, path)
    return iv.select("item_id", F.transform("item_vector", lambda x: F.round(x, 6)).alias("item_vector"),
                     r6("mean").alias("mean"), r6("std").alias("std"))


def q_read_vector_sets(spark, sf):
    r, iv = _vec_inputs(spark, sf, None)
    path = scratch_path(spark, "vector-sets")
    io.write_vector_sets(kernel.vector_sets(r, iv, P.N_USERS), path)
    back = io.read_vector_sets(spark, path)
    total = F.aggregate("unit_vector", F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_vectors"), r6(F.sum(total)).alias("total")).drop("set_id")


def source_queries() -> dict[str, Query]:
    return {"read_ratings": q_read_ratings, "read_items": q_read_items,
            "read_item_vectors": q_read_item_vectors, "read_vector_sets": q_read_vector_sets}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(stats_queries())
    out.update(posterior_queries())
    out.update(vector_queries())
    out.update(study_queries())
    out.update(kernel_queries())
    out.update(source_queries())
    return out
