import hashlib
import numpy as np
from pyspark.sql import functions as F

from rating_rows import SF001, ratings_df
from ratinglab.operators import als, study
from ratinglab.sources import fixtures as fx


def test_planted_low_rank_als(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(60, 2)), rng.normal(size=(40, 2))
    full = u @ v.T + 3.0
    rows = [(i, j, float(full[i, j] + rng.normal(scale=0.05))) for i in range(60) for j in range(40)
            if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    # rank-2 factors plus a constant offset: rank 3 (ALS has no bias term)
    runs, _ = als.als_runs(df, rank=3, max_iter=15, reg=0.01, runs=2, seed=3)
    r = runs.orderBy("run").collect()
    var = np.var([x[2] for x in rows])
    assert all(x["mse"] < 0.1 * var for x in r)
    again, _ = als.als_runs(df, rank=3, max_iter=15, reg=0.01, runs=1, seed=3)
    assert abs(again.first()["mse"] - r[0]["mse"]) < 1e-9


def test_normalized_als_writes_model_table(spark):
    from ratinglab.operators import posterior
    r = fx.ratings(spark, SF001).cache()
    st = posterior.item_stats(r, 42, trusted_min=30, sample_min=28)
    runs, table = als.als_runs(r, mode="normalized", rank=4, max_iter=5, runs=1, item_stats=st)
    assert runs.first()["n_scored"] > 0
    assert set(table.columns) == {"item_id", "item_vector", "mean", "std"}


def test_multinomial_counts_sum_to_n(spark):
    r = fx.ratings(spark, SF001)
    pm = study.study_pmfs(r, 42, trusted_min=20, test_ratio=0.5)
    c = study.multinomial_counts(pm.where("is_test"), (5, 25), 42)
    bad = c.where(F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4") + F.col("c5") != F.col("n")).count()
    assert c.count() > 0 and bad == 0


def test_posterior_beats_sample_mean_on_small_n(spark):
    r = fx.ratings(spark, SF001)
    mse = {(x["n"], x["statistic"], x["estimator"]): x["mse"]
           for x in study.study_mse(study.study_errors(r, 42, trusted_min=20, sizes=(5,), test_ratio=0.3)).collect()}
    assert mse[(5, "mean", "posterior")] < mse[(5, "mean", "sample")]


def _hashed(seed, j, i):
    return (int(hashlib.md5(f"{seed}|als{j}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52


def test_als_sweeps_equal_dense_solutions(spark):
    """One user rates everything, one item has one rating; factors equal numpy's, the loss never rises."""
    rng = np.random.default_rng(2)
    rows = [(1, i, float(rng.integers(1, 11)) / 2) for i in range(40)]
    rows += [(u, int(i), float(rng.integers(1, 11)) / 2) for u in range(2, 15) for i in rng.choice(40, 6, replace=False)]
    rows.append((15, 99, 4.0))
    df = ratings_df(spark, rows)
    rank, reg = 3, 0.1
    items = {i: np.array([_hashed(7, j, i) for j in range(rank)]) for i in {r[1] for r in rows}}

    def half(by, fixed, other):
        out = {}
        for k in {r[by] for r in rows}:
            x = np.stack([fixed[r[other]] for r in rows if r[by] == k])
            y = np.array([r[2] for r in rows if r[by] == k])
            out[k] = np.linalg.solve(x.T @ x + reg * len(y) * np.eye(rank), x.T @ y)
        return out
    losses = []
    for sweeps in (1, 2, 3):
        users = half(0, items, 1)
        items = half(1, users, 0)
        u, v = als.als_sweeps(df, rank, reg, sweeps, 7)
        for frame, want in ((u, users), (v, items)):
            got = {r["id"]: np.array([r[f"x{i}"] for i in range(rank)]) for r in frame.collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
        row = als.sweep_objective(df, u, v, rank, reg).first()
        assert row.n == len(rows)
        losses.append(row.loss)
    assert losses[0] >= losses[1] >= losses[2]


def test_als_sweeps_with_hot_ids_nulls_and_repeats(spark, monkeypatch):
    """Blocks, slices and ids without a block change no factor; null keys and ratings go as in half_sweep."""
    rng = np.random.default_rng(4)
    rows = [(1, i, float(rng.integers(1, 11)) / 2) for i in range(30)]
    rows += [(u, int(i), float(rng.integers(1, 11)) / 2) for u in range(2, 20) for i in rng.choice(30, 5)]
    rows += [(3, 7, 2.0), (3, 7, 2.0), (None, 4, 3.0), (None, 5, 1.0), (6, None, 1.0), (7, 8, None), (22, None, 2.0)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    items = als.start_factors(df.select(F.col("item_id").alias("id")).distinct(), 3, 7)
    users = als.half_sweep(df, "user_id", "item_id", items, 3, 0.1)
    items = als.half_sweep(df, "item_id", "user_id", users, 3, 0.1)

    def found(frame):
        out = {r["id"]: np.array([r[f"x{i}"] for i in range(3)]) for r in frame.collect()}
        assert len(out) == frame.count()
        return out
    want = found(users), found(items)
    for hot, size in ((1 << 20, 1 << 17), (10, 16), (0, 16)):
        monkeypatch.setattr(als, "HOT_ROWS", hot)
        monkeypatch.setattr(als, "SLICE_ROWS", size)
        monkeypatch.setattr(als, "BLOCK_ROWS", 40)
        for frame, w in zip(als.als_sweeps(df, 3, 0.1, 1, 7), want):
            got = found(frame)
            assert got.keys() == w.keys() and all(np.allclose(got[k], w[k], equal_nan=True) for k in w)


def test_als_sweeps_send_a_factor_once_to_a_block(spark):
    df = ratings_df(spark, [(u, i, 3.0) for u in range(60) for i in range(50)])
    rows, needs, hot = als.packed(df, "item_id", "user_id", 4)
    assert hot is None and rows.count() == 50
    factors = als.start_factors(needs.select("id"), 2, 7)
    assert als.sent(factors, needs).groupBy("id", "block").count().agg(F.max("count"), F.count("*")).first() == (1, 200)


def test_item_statistics_are_worked_out_once(spark):
    """A row function counts how often the statistics are read from their source."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    r = ratings_df(spark, [(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(10)])
    st = spark.createDataFrame([(i, 3.0, 1.0) for i in range(10)], "item_id int, mean double, std double").mapInArrow(
        read, "item_id int, mean double, std double")
    _, table = als.als_runs(r, mode="normalized", rank=2, max_iter=2, runs=1, item_stats=st)
    assert table.count() == 10 and seen.value == 10


def test_item_blocks_change_no_result(spark, monkeypatch):
    """The users' blocks choose the start; the items' are fewer in the queries and choose nothing."""
    from ratinglab.plans import params, queries
    rows = [(u, i, float((u * 7 + i * 3) % 5 + 1)) for u in range(60) for i in range(40) if (u + i) % 3]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    got = [als.als_runs(df, rank=3, max_iter=6, seed=5, num_blocks=8, item_blocks=n)[0].first() for n in (None, 3, 1)]
    for r in got[1:]:
        assert (r.n_scored, r.n_test) == (got[0].n_scored, got[0].n_test)
        assert abs(r.mse - got[0].mse) < 1e-6 * got[0].mse
    made, fitted = [], als._als
    monkeypatch.setattr(als, "_als", lambda *a: made.append(fitted(*a)) or made[-1])
    monkeypatch.setattr(params, "ALS_ITERATIONS", 1)
    found = queries.queries()
    for name in ("als_plain", "als_normalized", "als_cold_start", "als_model_table"):
        found[name](spark, SF001)
    assert len(made) == 5
    assert all(a.getNumUserBlocks() == params.ALS_BLOCKS == 8 and a.getNumItemBlocks() <= 3 for a in made)


def test_als_sweeps_of_no_ratings(spark):
    u, v = als.als_sweeps(ratings_df(spark, []), 3, 0.1, 1, 7)
    assert u.collect() == [] and v.collect() == []


def test_als_leaves_executors_room_for_blocks_of_ratings(spark, monkeypatch):
    """No table stays in executors' memory, blocks of ratings are on disk, and large inputs get more item blocks, which change
    no result."""
    from ratinglab.plans import queries
    real, made = als._als, []

    def seen(*args):
        made.append((real(*args), args))
        return made[-1][0]
    monkeypatch.setattr(als, "_als", seen)
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    first = queries.q_als_cold_start(spark, SF001).collect()
    mse = queries.queries()["als_normalized"](spark, SF001).first()["mse"]
    spark._jvm.System.gc()
    before = kept()
    assert queries.q_als_cold_start(spark, SF001).collect() == first and queries.q_als_model_table(spark, SF001).count()
    assert kept() <= before + 2  # the last model's factors
    assert {x[0].getIntermediateStorageLevel() for x in made} == {"DISK_ONLY"} and {x[0].getNumItemBlocks() for x in made} == {3}
    made.clear()
    monkeypatch.setattr(als, "ITEM_BLOCK_RATINGS", 1000)
    again = queries.queries()["als_normalized"](spark, SF001).first()["mse"]
    assert made[0][0].getNumItemBlocks() == 5 and made[0][0].getNumUserBlocks() == 8 and abs(again - mse) < 1e-6
