from pyspark.sql import functions as F

from rating_rows import SF001, ratings_df
from ratinglab.operators import posterior, stats
from ratinglab.sources import fixtures as fx


def test_only_half_star_ratings_empty_histogram(spark):
    h = stats.item_histogram(ratings_df(spark, [(1, 1, 0.5), (2, 1, 0.5)]), seed=1).first()
    assert h["n_raw"] == 2 and h["n_kept"] == 0 and [h[f"c{k}"] for k in range(1, 6)] == [0] * 5
    p = stats.item_pmf(stats.item_histogram(ratings_df(spark, [(1, 1, 0.5)]), 1)).first()
    assert [p[f"p{k}"] for k in range(1, 6)] == [0.2] * 5


def test_constant_item_has_zero_std(spark):
    m = stats.item_moments(stats.item_histogram(ratings_df(spark, [(u, 1, 4.0) for u in range(50)]), 1)).first()
    assert m["mean"] == 4.0 and m["std"] == 0.0


def test_half_stars_go_to_a_neighbour(spark):
    rows = [(u, i, r) for u in range(200) for i, r in enumerate([1.5, 2.5, 3.5, 4.5])]
    v = stats.noisy_ratings(ratings_df(spark, rows), seed=9).select("rating", "v").collect()
    for row in v:
        assert row["v"] in (int(row["rating"] - 0.5), int(row["rating"] + 0.5))
    ups = sum(1 for row in v if row["v"] > row["rating"])
    assert 300 < ups < 500


def test_pmf_sums_to_one(spark):
    rows = [(u, u % 5, 1.0 + (u % 9) * 0.5) for u in range(300)]
    p = stats.item_pmf(stats.item_histogram(ratings_df(spark, rows), 1))
    for r in p.collect():
        assert abs(sum(r[f"p{k}"] for k in range(1, 6)) - 1) < 1e-12


def test_trusted_is_strict(spark):
    rows = [(u, 1, 3.0) for u in range(10)] + [(u, 2, 3.0) for u in range(11)]
    t = stats.trusted_items(ratings_df(spark, rows), 10).collect()
    assert [r["item_id"] for r in t] == [2]


def test_item_stats_sources(spark):
    # item 1: many ratings (plain); item 2: cold (posterior); item 3: only 0.5 -> prior average
    rows = [(u, 1, float(1 + u % 5)) for u in range(60)] + [(u, 2, 5.0) for u in range(3)] + [(1, 3, 0.5)]
    st = {r["item_id"]: r for r in posterior.item_stats(ratings_df(spark, rows), 1, trusted_min=50,
                                                          sample_min=45).collect()}
    assert st[1]["source"] == "plain" and abs(st[1]["mean"] - 3.0) < 0.05
    assert st[2]["source"] == "posterior" and st[3]["source"] == "posterior"
    assert abs(st[3]["mean"] - st[1]["mean"]) < 0.05  # one prior: its moments


def test_tasks_of_the_rating_pairs_grow_with_the_rows(spark):
    """No task groups more than TASK_ROWS pairs, and none holds a table of pairs before the shuffle."""
    assert [fx.pair_tasks(n, 24) for n in (0, 1, 60_000, 600_000, 36_000_000, 216_000_000)] == [1, 1, 3, 24, 90, 540]
    plan = fx.ratings(spark, SF001)._jdf.queryExecution().analyzed().toString().splitlines()  # not swapped for a cached one
    group = next(k for k, line in enumerate(plan) if "Aggregate [o_custkey" in line)
    assert "RepartitionByExpression [o_custkey" in plan[group + 1]
