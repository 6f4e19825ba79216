import hashlib

import numpy as np

from ratinglab.operators import posterior, stats


def _priors(spark, pmfs):
    rows = [(i, *[float(x) for x in p]) for i, p in enumerate(pmfs)]
    df = spark.createDataFrame(rows, "prior_id int, p1 double, p2 double, p3 double, p4 double, p5 double")
    return df.select("*", stats.pmf_mean().alias("mean_q"), stats.pmf_std().alias("std_q"))


def _hists(spark, hists):
    return spark.createDataFrame([tuple(int(x) for x in h) for h in hists], "c1 long, c2 long, c3 long, c4 long, c5 long")


def test_alpha_nonpositive_and_zero_buckets():
    h = np.array([[0, 0, 0, 0, 3], [1, 2, 0, 0, 0], [0, 0, 0, 0, 0]], dtype=float)
    q = np.log(np.array([[0.1, 0.2, 0.3, 0.2, 0.2], [0.2] * 5]))
    alpha = h @ q.T + posterior._alpha_const(h)[:, None]
    assert np.all(np.isfinite(alpha)) and np.all(alpha <= 1e-12)
    assert np.all(alpha[2] == 0)


def test_closed_form_equals_brute_force_sampler(spark):
    rng = np.random.default_rng(0)
    pmfs = rng.dirichlet(np.ones(5) * 2, size=40)
    hist = np.array([2, 0, 1, 4, 3])
    out = posterior.posterior_moments(_hists(spark, [hist]), _priors(spark, pmfs)).first()
    # brute force: the reference's rejection loop, many accepts
    n = hist.sum()
    acc = []
    while len(acc) < 20000:
        j = rng.integers(len(pmfs), size=50000)
        q = pmfs[j]
        nz = hist > 0
        alpha = (hist[nz] * np.log(q[:, nz] * n / hist[nz])).sum(axis=1)
        keep = alpha > np.log(rng.random(len(j)))
        acc.extend(j[keep].tolist())
    acc = np.array(acc)
    means = (pmfs[acc] * np.arange(1, 6)).sum(axis=1)
    assert abs(out["mean"] - means.mean()) < 0.01


def test_empty_histogram_is_prior_average(spark):
    pmfs = [[0.1, 0.1, 0.2, 0.3, 0.3], [0.3, 0.3, 0.2, 0.1, 0.1]]
    out = posterior.posterior_moments(_hists(spark, [[0] * 5]), _priors(spark, pmfs)).first()
    assert abs(out["mean"] - 3.0) < 1e-12 and out["expected_proposals"] == 100.0


def test_impossible_prior_falls_back(spark):
    # one prior nearly all mass on 1; item rated 5 many times with max_iter tiny
    rows = [(u, 1, 1.0) for u in range(60)] + [(u, 2, 5.0) for u in range(40)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    st = {r["item_id"]: r for r in posterior.item_stats(df, 1, trusted_min=50, sample_min=45, max_iter=10).collect()}
    assert st[2]["source"] == "fallback" and st[2]["mean"] == 5.0


def test_posterior_sample_salting_and_moments(spark):
    rng = np.random.default_rng(3)
    pmfs = rng.dirichlet(np.ones(5) * 2, size=30)
    priors = _priors(spark, pmfs)
    items = spark.createDataFrame([(i, *[int(x) for x in rng.multinomial(8, [0.1, 0.2, 0.3, 0.2, 0.2])])
                                   for i in range(12)], "item_id int, c1 long, c2 long, c3 long, c4 long, c5 long")
    a = posterior.posterior_sample(items, priors, seed=5, accepts=400, priors_per_bucket=8).toPandas()
    b = posterior.posterior_sample(items, priors, seed=5, accepts=400, priors_per_bucket=5, max_draws_per_group=50).toPandas()
    key = ["item_id", "draw"]
    assert len(a) == 12 * 400
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    sampled = posterior.sampled_moments(spark.createDataFrame(a), priors).toPandas().set_index("item_id")
    exact = posterior.posterior_moments(items.select(*stats.COUNT_COLS), priors).toPandas()
    joined = items.toPandas().merge(exact, on=stats.COUNT_COLS).set_index("item_id")
    assert (sampled["mean"] - joined["mean"]).abs().max() < 0.05


def _brute_sums(hists, pmfs):
    h, q = np.array(hists, float), np.array(pmfs)
    w = np.exp(h @ np.log(q).T + posterior._alpha_const(h)[:, None])
    mean = q @ np.arange(1.0, 6.0)
    std = np.sqrt((q * (np.arange(1.0, 6.0) - mean[:, None]) ** 2).sum(axis=1))
    return np.stack([w.sum(axis=1), w @ mean, w @ std], axis=1)


def test_grid_of_blocks_equals_brute_force_with_repeated_priors(spark, monkeypatch):
    """Histograms of up to 110 ratings, priors that repeat, many small blocks on both sides."""
    rng = np.random.default_rng(9)
    hists = np.unique([rng.multinomial(n, rng.dirichlet(np.ones(5))) for n in rng.integers(0, 111, 400)], axis=0)
    pmfs = rng.dirichlet(np.ones(5) * 2, size=60)[rng.integers(0, 60, 500)]
    for name, value in (("HIST_ROWS", 40), ("PRIOR_ROWS", 16), ("SMALL_HIST", 1), ("TILE", 64)):
        monkeypatch.setattr(posterior, name, value)
    got = posterior.posterior_sums(_hists(spark, np.repeat(hists, 2, axis=0)), _priors(spark, pmfs)).toPandas()
    got = got.sort_values(stats.COUNT_COLS)
    assert (got[stats.COUNT_COLS].to_numpy() == hists).all() and (got.n_q == 500).all()
    assert np.allclose(got[list(posterior.SUMS)].to_numpy(), _brute_sums(hists, pmfs), rtol=1e-9)


def test_item_stats_with_the_reference_thresholds(spark):
    """sample_min 110: items of up to 109 ratings go through the posterior."""
    rng = np.random.default_rng(4)
    rows = [(u, i, float(r)) for i in range(60) for u, r in enumerate(
        rng.choice([1, 2, 3, 4, 5], p=rng.dirichlet(np.ones(5) * 3), size=130 if i < 30 else int(rng.integers(1, 110))))]
    df = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    hist = stats.item_histogram(df, 1).toPandas().set_index("item_id")
    trusted = hist[hist.n_raw > 110]
    pmfs = (trusted[stats.COUNT_COLS].to_numpy() + 1) / (trusted.n_kept.to_numpy()[:, None] + 5.0)
    got = {r.item_id: r for r in posterior.item_stats(df, 1, trusted_min=110, sample_min=110).collect()}
    assert len(trusted) == 30 and len(got) == 60
    n_post = 0
    for i in range(30, 60):
        total, mean, std = _brute_sums([hist.loc[i, stats.COUNT_COLS].to_numpy(float)], pmfs)[0]
        if total / 30 * 100000 >= 1:
            n_post += 1
            assert got[i].source == "posterior" and abs(got[i]["mean"] - mean / total) < 1e-9 and abs(got[i]["std"] - std / total) < 1e-9
    assert n_post > 20 and all(got[i].source == "plain" for i in range(30))


def _u(seed, item, draw):
    return (int(hashlib.md5(f"{seed}|post|{item}|{draw}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52


def test_draws_with_clustered_priors_and_a_dominant_histogram(spark):
    """Prior ids in two far clusters; nine of ten items share one histogram."""
    rng = np.random.default_rng(11)
    ids = np.concatenate([np.arange(90), 2_000_000_000 + np.arange(10)])
    pmfs = rng.dirichlet(np.ones(5), size=100)
    priors = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, pmfs)],
                                   "prior_id int, p1 double, p2 double, p3 double, p4 double, p5 double")
    buckets, n = posterior.prior_buckets(priors, 10)
    sizes = [r["count"] for r in buckets.groupBy("b").count().collect()]
    assert n == 10 and sum(sizes) == 100 and max(sizes) <= 25  # equal id ranges would hold 90 and 10
    hists = [[3, 0, 2, 1, 4] if i % 10 else list(rng.multinomial(12, [0.2] * 5)) for i in range(50)]
    items = spark.createDataFrame([(i, *map(int, h)) for i, h in enumerate(hists)], "item_id int, c1 long, c2 long, c3 long, c4 long, c5 long")
    got = posterior.posterior_sample(items, priors, 3, accepts=40, max_draws_per_group=60, priors_per_bucket=10).collect()
    want = {}
    for i, h in enumerate(hists):
        h = np.array([h], float)
        cum = np.cumsum(np.exp(h @ np.log(pmfs).T + posterior._alpha_const(h)[:, None])[0])
        for d in range(1, 41):
            want[i, d] = int(ids[np.searchsorted(cum, _u(3, i, d) * cum[-1], side="right")])
    assert {(r.item_id, r.draw): r.prior_id for r in got} == want and len(got) == len(want)


def test_posterior_without_priors_or_items(spark):
    none = _priors(spark, [[0.2] * 5]).limit(0)
    assert posterior.posterior_sums(_hists(spark, [[1, 0, 0, 0, 0]]), none).collect() == []
    items = spark.createDataFrame([], "item_id int, c1 long, c2 long, c3 long, c4 long, c5 long")
    assert posterior.posterior_sample(items, _priors(spark, [[0.2] * 5]), 1).collect() == []
    one = spark.createDataFrame([(1, 1, 0, 0, 0, 0)], items.schema)
    assert posterior.posterior_sample(one, none, 1).collect() == []
