import numpy as np
from pyspark.sql import functions as F

from rating_rows import SF001
from ratinglab.functions.scoring import INFERENCE_KERNEL
from ratinglab.operators import kernel
from ratinglab.session import scratch_path
from ratinglab.sources import fixtures as fx
from ratinglab.sources import io


def _split(spark):
    r = fx.ratings(spark, SF001).cache()
    iv = fx.item_vectors(spark, SF001, 6, r)
    return kernel.kde_split(kernel.vector_sets(r, iv, 40), 42).cache(), kernel.vector_sets(r, iv, 40)


def test_reference_kernel_mass_by_rank(spark):
    m6 = kernel.kernel_mass(spark, [(0.4, INFERENCE_KERNEL)], 6).first()["mass"]
    m4 = kernel.kernel_mass(spark, [(0.4, INFERENCE_KERNEL)], 4).first()["mass"]
    assert abs(m6 - 0.997) < 0.002 and abs(m4 - 2.82) < 0.01


def test_em_fit_monotone_unit_mass(spark):
    sp, _ = _split(spark)
    f = kernel.fit_kernel(sp, 0.3, 6, m=8, steps=15)
    h = np.array(f["history"])
    assert np.all(np.diff(h) <= 1e-12)
    assert abs(sum(f["weights"]) - 1) < 1e-9 and min(f["weights"]) >= 0
    mass = kernel.kernel_mass(spark, [(0.3, f["coeffs"])], 6).first()["mass"]
    assert abs(mass - 1) < 1e-3
    assert kernel.kernel_min(spark, [(0.3, f["coeffs"])]).first()["min_g"] > -1e-9


def test_kde_values_against_numpy(spark):
    sp, _ = _split(spark)
    v = kernel.kde_values(sp, [INFERENCE_KERNEL], [0.4]).toPandas()
    p = sp.toPandas()
    u = v.user_id.iloc[0]
    ref = np.stack(p[(p.user_id == u) & p.is_ref].unit_vector.to_numpy())
    for _, row in v[v.user_id == u].iterrows():
        y = np.array(p[(p.user_id == u) & (p.item_id == row.item_id)].unit_vector.iloc[0])
        d = ref @ y
        f = np.where(d > 0.4, np.polyval(INFERENCE_KERNEL[::-1], np.minimum(d, 1)), 0).mean()
        assert abs(f - row.value) < 1e-12


def test_vector_sets_text_round_trip(spark):
    _, vs = _split(spark)
    path = scratch_path(spark, "t-vs")
    io.write_vector_sets(vs, path)
    back = io.read_vector_sets(spark, path)
    sizes = sorted(r["count"] for r in back.groupBy("set_id").count().collect())
    assert sizes == sorted(r["count"] for r in vs.groupBy("user_id").count().collect())
    got = sorted(tuple(round(x, 9) for x in r["unit_vector"]) for r in back.collect())
    exp = sorted(tuple(round(x, 9) for x in r["unit_vector"]) for r in vs.collect())
    assert got == exp


def test_csv_and_parquet_round_trips(spark):
    r = fx.ratings(spark, SF001)
    p1 = scratch_path(spark, "t-r")
    io.write_ratings(r, p1)
    assert sorted(io.read_ratings(spark, p1).collect()) == sorted(r.collect())
    items = spark.createDataFrame([(1, 'Heat, "the" film (1995)'), (2, "plain")], "item_id int, title string")
    p2 = scratch_path(spark, "t-i")
    io.write_items(items, p2)
    assert sorted(io.read_items(spark, p2).collect()) == sorted(items.collect())
    iv = fx.item_vectors(spark, SF001)
    p3 = scratch_path(spark, "t-v")
    io.write_item_vectors(iv, p3)
    assert sorted(io.read_item_vectors(spark, p3).collect()) == sorted(iv.collect())
    try:
        io.write_item_vectors(iv, p3)
        raise AssertionError("expected an error for an existing path")
    except Exception as e:  # AnalysisException
        assert "already exists" in str(e).lower() or "exist" in str(e).lower()


def test_losses_study_and_kernel_sinks(spark):
    runs = spark.createDataFrame([(2, 0.5), (1, 0.25)], "run int, mse double")
    p = scratch_path(spark, "t-l")
    io.write_losses(runs, p)
    assert [r["value"] for r in spark.read.text(p).collect()] == ["0.25", "0.5"]
    sweep = spark.createDataFrame([(0.4, [1.0, 2.0], True), (0.5, [3.0], False)],
                                  "cutoff double, coeffs array<double>, accepted boolean")
    pk = scratch_path(spark, "t-k")
    io.write_kernel(sweep, pk)
    k = io.read_kernel(spark, pk).collect()
    assert len(k) == 1 and k[0]["cutoff"] == 0.4 and k[0]["coeffs"] == [1.0, 2.0]


def test_blocks_of_vectors_add_up(spark, monkeypatch):
    """Held-out and reference vectors in blocks of three: the same arrays as in one block each."""
    sp, _ = _split(spark)
    args = (sp, [INFERENCE_KERNEL, [0.0, 1.0] + [0.0] * 4], [0.4, 0.0])
    key = ["user_id", "item_id", "row"]
    whole = kernel.kde_values(*args).toPandas().sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(kernel, "HELD_ROWS", 3)
    monkeypatch.setattr(kernel, "REF_ROWS", 3)
    parts = kernel.kde_values(*args).toPandas().sort_values(key).reset_index(drop=True)
    assert len(whole) and parts[key].equals(whole[key]) and np.allclose(parts.value, whole.value, atol=1e-9)


def test_split_needs_no_window_without_partitions(spark):
    r = fx.ratings(spark, SF001)
    sets = kernel.vector_sets(r, fx.item_vectors(spark, SF001, 6, r), 40).cache()
    plan = kernel.kde_split(sets, 42)._jdf.queryExecution().toString()
    assert "Window" in plan and "SinglePartition" not in plan.split("== Physical Plan ==")[1].split("InMemoryRelation")[0]


def test_ranks_over_ranges(spark):
    from ratinglab.operators import splits
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 997), rng.permutation(997))]
    df = spark.createDataFrame(rows, "a int, b int").repartition(9)
    out, n = splits.ranked(df, F.col("a").desc(), F.col("b"))
    want = {r: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert n == 997 and {(r.a, r.b): r["rank"] for r in out.collect()} == want
    empty, n = splits.ranked(df.limit(0), F.col("b"))
    assert n == 0 and empty.collect() == []


def test_em_steps_lower_the_objective(spark):
    sp, _ = _split(spark)
    rows = kernel.em_steps(sp, (0.0, 0.3), 6, 8, 4).orderBy("cutoff", "step").collect()
    for c in (0.0, 0.3):
        mine = [r for r in rows if r.cutoff == c]
        assert [r.step for r in mine] == [1, 2, 3, 4]
        assert all(abs(sum(r.weights) - 1.0) < 1e-9 and min(r.weights) >= 0 for r in mine)
        assert all(a.objective >= b.objective - 1e-12 for a, b in zip(mine, mine[1:]))
    fit = kernel.fit_kernel(sp, 0.3, 6, m=8, steps=4)
    assert abs(fit["history"][0] - [r for r in rows if r.cutoff == 0.3][0].objective) < 1e-9


def test_polynomial_fit_is_in_the_family_and_no_worse(spark):
    """Degree 5, value 1e-5 at the cutoff, rising, unit mass, converged; no worse than the mixture fits."""
    sp, _ = _split(spark)
    cutoffs = (0.0, 0.2, 0.4)
    fits = kernel.fit_polynomials(sp, cutoffs, 6)
    same_degree, wide = (kernel.fit_kernels(sp, cutoffs, 6, m=m, steps=60) for m in (5, 12))
    mass = {r["cutoff"]: r["mass"] for r in kernel.kernel_mass(spark, [(f["cutoff"], f["coeffs"]) for f in fits], 6).collect()}
    nll = {r["cutoff"]: r["nll"] for r in kernel.kde_nll(sp, [(f["cutoff"], f["coeffs"]) for f in fits], users="fit").collect()}
    for f, a, b in zip(fits, same_degree, wide):
        c, p = f["cutoff"], np.polynomial.Polynomial(f["coeffs"])
        assert f["converged"] and len(f["coeffs"]) == 6
        assert abs(p(c) - 1e-5) < 1e-9 and abs(mass[c] - 1.0) < 1e-6
        assert f["min_slope"] >= 0.0 and (p.deriv()(np.linspace(c, 1.0, 5001)) > -1e-9).all()
        assert abs(nll[c] - f["train_nll"]) < 1e-6
        assert f["train_nll"] <= a["train_nll"] + 1e-6 and f["train_nll"] <= b["train_nll"] + 1e-3
    sweep = kernel.polynomial_sweep(sp, (0.3,), 6).first()
    assert sweep.accepted and sweep.converged and sweep.test_nll is not None
