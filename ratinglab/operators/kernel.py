"""Kernel density on the sphere over users' item vectors.

* ``top_users`` / ``vector_sets``: the most active users and the unit vectors of the
  items they rated (the reference exports these to a text file for a separate program).
* ``kde_split``: users split 4/5 (fit) and 1/5 (test) by a seeded hash. Within a fit
  user, a seeded shuffle puts 9/10 of the vectors in the reference set and holds out the
  rest; within a test user the first 4/5 in order are the reference set.
* ``kde_arrays``: for every held-out vector y of user u, the array over polynomial rows k of
  ``mean over u's reference vectors x of [dot(x, y) > c_k] * poly_k(dot)``.
  This is the within-user pairwise step. It is not a self-join emitting every pair: a user's
  held-out and reference vectors are cut into blocks, one cogrouped step per (user, held block,
  reference block) returns one array of sums per held-out vector, and a user's arrays over several
  reference blocks are added element by element.
* ``kde_nll``: mean over test users of the mean ``-ln(max(1e-10, f))``.
* ``fit_polynomials``: the reference's family, a degree-5 polynomial above the cutoff that rises from
  ``AT_CUTOFF`` with a slope of at least ``SLOPE`` and has unit mass, by Newton steps on a log barrier;
  gradient and Hessian are one distributed aggregate, the system it solves has six unknowns.
* ``fit_kernel`` (re-aimed): the reference solves a cone program on one machine; here a
  kernel is a mixture of monotone Bernstein tail bases, each normalised to unit mass on
  the sphere, and EM fits the mixture weights. Each EM step is one aggregate over a
  cached feature table; only the weights (a dozen doubles) visit the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratinglab.functions.rng import hash_uniform
from ratinglab.operators import blocks, similarity, splits
from ratinglab.session import ship_package

FLOOR = 1e-10


# ------------------------------------------------------------------ vector sets

def top_users(ratings: DataFrame, n_users: int) -> DataFrame:
    """The ``n_users`` users with most ratings (ties: lower id). A top-k report."""
    counts = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("user_id").asc()).limit(int(n_users))


def vector_sets(ratings: DataFrame, item_vectors: DataFrame, n_users: int) -> DataFrame:
    """A6 + J4: ``user_id, pos, item_id, item_vector, unit_vector`` for the top users (pos by item id).
    Users whose rated items have no vector drop out, as with the reference's inner join."""
    top = top_users(ratings, n_users).select("user_id")
    r = ratings.select("user_id", "item_id").join(F.broadcast(top), "user_id", "left_semi")
    unit = similarity.normalized_vectors(item_vectors).select("item_id", "item_vector", "unit_vector")
    j = r.join(unit, "item_id")
    w = Window.partitionBy("user_id").orderBy("item_id")
    return j.select("user_id", F.row_number().over(w).alias("pos"), "item_id", "item_vector", "unit_vector")


def kde_split(sets: DataFrame, seed: int) -> DataFrame:
    """Adds ``is_fit_user`` and ``is_ref`` (reference vector vs. held-out vector)."""
    users, n_users = splits.ranked(sets.select("user_id").distinct(), hash_uniform(seed, "kuser", "user_id"), F.col("user_id"))
    s = sets.join(users.select("user_id", (F.col("rank") <= n_users * 4 // 5).alias("is_fit_user")), "user_id")
    shuffled = Window.partitionBy("user_id").orderBy(hash_uniform(seed, "kfit", "user_id", "item_id"), "item_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    s = s.withColumn("_spos", F.row_number().over(shuffled)).withColumn("_n", n)
    is_ref = F.when(F.col("is_fit_user"), F.col("_spos") <= F.floor(F.col("_n") * 9 / 10)) \
        .otherwise(F.col("pos") <= F.floor(F.col("_n") * 4 / 5))
    return s.select("user_id", "pos", "item_id", "unit_vector", "is_fit_user", is_ref.alias("is_ref"))


# ------------------------------------------------------------------ pairwise kernel values

#: Vectors of a user's held-out block and of a reference block.
HELD_ROWS, REF_ROWS = 1 << 12, 1 << 13
_ARRAYS = pa.schema([("user_id", pa.int64()), ("item_id", pa.int32()), ("n_ref", pa.int64()), ("sums", pa.list_(pa.float64()))])


def _arrays_cell(coeffs: np.ndarray, cutoffs: np.ndarray, shifts: np.ndarray, scales: np.ndarray, cap: bool, strict: bool):
    def run(held: pa.Table, ref: pa.Table) -> pa.Table:
        if not len(held):
            return _ARRAYS.empty_table()
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        sums = np.zeros((len(held), len(cutoffs)))
        if len(ref):
            x, y = flat(ref.sort_by("ref_item"), "ref_vector"), flat(held, "unit_vector")
            step = blocks.row_block(len(y), 1 << 18)
            for lo in range(0, len(x), step):
                d = y @ x[lo:lo + step].T
                t = np.minimum(d, 1.0) if cap else d
                for k in range(len(cutoffs)):
                    z = (t - shifts[k]) / scales[k]
                    p = np.full_like(z, coeffs[k, -1])
                    for c in coeffs[k, -2::-1]:
                        p *= z
                        p += c
                    sums[:, k] += np.where(d > cutoffs[k] if strict else d >= cutoffs[k], p, 0.0).sum(axis=1)
        return pa.table([held.column("user_id").cast(pa.int64()), held.column("item_id"), pa.array(np.full(len(held), len(ref))),
                         pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), len(cutoffs)).cast(pa.list_(pa.float64()))],
                        schema=_ARRAYS)
    return run


def kde_arrays(split: DataFrame, coeffs, cutoffs, shifts=None, scales=None, cap: bool = True, strict: bool = True) -> DataFrame:
    """J12 + A15: ``user_id, item_id (held out), values`` where element k of ``values`` is the mean
    over the user's reference vectors of ``[dot > cutoff] * poly((t - shift) / scale)`` of row k,
    ``t = min(dot, 1)`` when ``cap``. NULL when the user has no reference vector."""
    coeffs = np.atleast_2d(np.asarray(coeffs, dtype=np.float64))
    cutoffs = np.asarray(cutoffs, dtype=np.float64)
    shifts = np.zeros(len(cutoffs)) if shifts is None else np.asarray(shifts, dtype=np.float64)
    scales = np.ones(len(cutoffs)) if scales is None else np.asarray(scales, dtype=np.float64)
    ship_package(split.sparkSession)
    count = lambda c, rows: F.greatest(F.lit(1), F.ceil(F.count(F.when(c, 1)) / F.lit(rows))).cast("int")
    cuts = split.groupBy("user_id").agg(count(~F.col("is_ref"), HELD_ROWS).alias("hbs"), count(F.col("is_ref"), REF_ROWS).alias("rbs"))
    rows = split.select("user_id", "item_id", "unit_vector", "is_ref").join(cuts, "user_id")

    def side(df, mine, n_mine, other, n_other):
        return df.select("user_id", "item_id", "unit_vector", F.pmod(F.xxhash64("item_id"), F.col(n_mine)).cast("int").alias(mine),
                         F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other))
    held = side(rows.where(~F.col("is_ref")), "hb", "hbs", "rb", "rbs")
    ref = side(rows.where(F.col("is_ref")), "rb", "rbs", "hb", "hbs").toDF("ref_user", "ref_item", "ref_vector", "ref_rb", "ref_hb")
    parts = held.groupBy("user_id", "hb", "rb").cogroup(ref.groupBy("ref_user", "ref_hb", "ref_rb")).applyInArrow(
        _arrays_cell(coeffs, cutoffs, shifts, scales, cap, strict), "user_id bigint, item_id int, n_ref bigint, sums array<double>")
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    whole = parts.groupBy("user_id", "item_id").agg(F.sum("n_ref").alias("n"), F.collect_list("sums").alias("s")).select(
        "user_id", "item_id", "n", F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), F.get("s", F.lit(0)), add).alias("s"))
    return whole.select(F.col("user_id").cast(split.schema["user_id"].dataType).alias("user_id"), "item_id",
                        F.when(F.col("n") > 0, F.transform("s", lambda x: x / F.col("n"))).alias("values"))


def kde_values(split: DataFrame, coeffs, cutoffs, shifts=None, scales=None, cap: bool = True, strict: bool = True) -> DataFrame:
    """``kde_arrays`` as rows ``user_id, item_id, row, value``."""
    v = kde_arrays(split, coeffs, cutoffs, shifts, scales, cap, strict)
    return v.select("user_id", "item_id", F.posexplode(
        F.coalesce("values", F.array_repeat(F.lit(None).cast("double"), len(cutoffs)))).alias("row", "value"))


# ------------------------------------------------------------------ losses and features

def chebyshev_coeffs(degree: int) -> np.ndarray:
    """Monomial coefficients (low order first) of T_0..T_degree, one row each."""
    rows = np.zeros((degree + 1, degree + 1))
    for k in range(degree + 1):
        c = np.polynomial.chebyshev.cheb2poly([0] * k + [1])
        rows[k, :len(c)] = c
    return rows


def kernel_features(split: DataFrame, cutoffs, degree: int = 5) -> DataFrame:
    """A15 (reference form): for held-out vectors of fit users,
    ``phi_k = mean over reference x of [dot > c] T_k(dot)`` for k = 0..degree, per cutoff."""
    basis = chebyshev_coeffs(degree)
    rows, cs = [], []
    for c in cutoffs:
        for k in range(degree + 1):
            rows.append(basis[k])
            cs.append(c)
    fit = split.where(F.col("is_fit_user"))
    v = kde_values(fit, np.array(rows), np.array(cs), cap=False, strict=True)
    names = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.lit(i % (degree + 1)).alias("k")) for i, c in enumerate(cs)])
    v = v.withColumn("of", F.get(names, F.col("row")))
    return v.select("user_id", "item_id", "of.cutoff", "of.k", F.col("value").alias("phi"))


def kde_nll(split: DataFrame, kernels: list[tuple[float, list[float]]], users: str = "test") -> DataFrame:
    """``cutoff, nll`` per kernel row ``(cutoff, monomial coefficients)``: mean over
    users of the mean ``-ln(max(1e-10, f))`` over held-out vectors (fit or test users)."""
    deg = max(len(c) for _, c in kernels)
    coeffs = np.zeros((len(kernels), deg))
    for i, (_, c) in enumerate(kernels):
        coeffs[i, :len(c)] = c
    cutoffs = [c for c, _ in kernels]
    sel = split.where(~F.col("is_fit_user")) if users == "test" else split.where(F.col("is_fit_user"))
    v = kde_values(sel, coeffs, cutoffs, cap=True, strict=True)
    loss = -F.log(F.greatest(F.col("value"), F.lit(FLOOR)))
    per_user = v.groupBy("row", "user_id").agg(F.avg(loss).alias("user_nll"))
    n_users = sel.select("user_id").distinct().count()
    per_row = per_user.groupBy("row").agg((F.sum("user_nll") / F.lit(float(max(n_users, 1)))).alias("nll"))
    cm = F.create_map(*[x for i, c in enumerate(cutoffs) for x in (F.lit(i), F.lit(float(c)))])
    return per_row.select(cm[F.col("row")].alias("cutoff"), "nll")


# ------------------------------------------------------------------ sphere integrals

def sphere_area(n: int) -> float:
    """F16: C(n) = 2 pi^(n/2) / Gamma(n/2), the area of the unit sphere in R^n."""
    return 2.0 * math.exp((n / 2) * math.log(math.pi) - math.lgamma(n / 2))


def kernel_mass(spark, kernels: list[tuple[float, list[float]]], rank: int, points: int = 200_000) -> DataFrame:
    """``cutoff, mass`` = C(rank-1) * integral_c^1 g(t) (1 - t^2)^((rank-3)/2) dt,
    midpoint rule on ``spark.range`` (one aggregate column per kernel row)."""
    cols = []
    for i, (c, co) in enumerate(kernels):
        h = (1.0 - c) / points
        t = F.lit(c) + (F.col("id").cast("double") + F.lit(0.5)) * F.lit(h)
        g = F.lit(float(co[-1]))
        for a in reversed(co[:-1]):
            g = g * t + F.lit(float(a))
        w = F.pow(F.lit(1.0) - t * t, F.lit((rank - 3) / 2.0))
        cols.append((F.sum(g * w) * F.lit(h * sphere_area(rank - 1))).alias(f"m{i}"))
    row = spark.range(points).agg(*cols)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"m{i}").alias("mass"))
                                          for i, (c, _) in enumerate(kernels)])).alias("r")).select("r.*")


def kernel_min(spark, kernels: list[tuple[float, list[float]]], points: int = 10_001) -> DataFrame:
    """``cutoff, min_g`` on a grid over [c, 1] (the reference checks stationary points)."""
    cols = []
    for i, (c, co) in enumerate(kernels):
        t = F.lit(c) + F.col("id").cast("double") * F.lit((1.0 - c) / (points - 1))
        g = F.lit(float(co[-1]))
        for a in reversed(co[:-1]):
            g = g * t + F.lit(float(a))
        cols.append(F.min(F.when(t > F.lit(c), g)).alias(f"m{i}"))
    row = spark.range(points).agg(*cols)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"m{i}").alias("min_g"))
                                          for i, (c, _) in enumerate(kernels)])).alias("r")).select("r.*")


# ------------------------------------------------------------------ kernel fit (EM)

def bernstein_tail_coeffs(m: int) -> np.ndarray:
    """Rows j = 1..m: coefficients in s (low order first) of H_j(s) = sum_{i>=j} B_{i,m}(s)."""
    rows = np.zeros((m, m + 1))
    for j in range(1, m + 1):
        acc = np.zeros(m + 1)
        for i in range(j, m + 1):
            b = np.polynomial.polynomial.polymul(
                np.polynomial.polynomial.polypow([0.0, 1.0], i),
                np.polynomial.polynomial.polypow([1.0, -1.0], m - i)) * math.comb(m, i)
            acc[:len(b)] += b
        rows[j - 1] = acc
    return rows


def _basis_masses(s_coeffs: np.ndarray, cutoff: float, rank: int, points: int = 20_000) -> np.ndarray:
    """Sphere mass of each basis row (a polynomial in s on t in (c, 1]); a fixed
    one-dimensional integral of known polynomials, computed once on the driver."""
    h = (1.0 - cutoff) / points
    t = cutoff + (np.arange(points) + 0.5) * h
    s = (t - cutoff) / (1.0 - cutoff)
    w = (1.0 - t * t) ** ((rank - 3) / 2.0) * h * sphere_area(rank - 1)
    vals = np.array([np.polynomial.polynomial.polyval(s, row) for row in s_coeffs])
    return vals @ w


def s_to_t(s_coeffs: np.ndarray, cutoff: float) -> np.ndarray:
    """Re-express a polynomial in s = (t - c)/(1 - c) in the monomial basis of t."""
    lin = np.array([-cutoff / (1.0 - cutoff), 1.0 / (1.0 - cutoff)])
    out = np.zeros(len(s_coeffs))
    for k, a in enumerate(s_coeffs):
        term = np.polynomial.polynomial.polypow(lin, k) * a
        out[:len(term)] += term
    return out


def _em_step_kernel(pi: np.ndarray):
    """Partial E/M sums of one task as one array: per cutoff, sum_i w_i * pi_j phi_ij / dens_i
    (live rows only), sum of live w, and the objective sum_i w_i * -ln(max(dens_i, floor))."""
    nc, m = pi.shape

    def run(batches):
        acc = np.zeros((nc, m + 2))
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column("w").to_numpy()
            phi = b.column("phi").flatten().to_numpy(zero_copy_only=False).reshape(-1, nc, m)
            dens = np.einsum("ncm,cm->nc", phi, pi)
            live = dens > 0
            resp = phi * pi[None, :, :] / np.where(live, dens, 1.0)[:, :, None]
            acc[:, :m] += np.einsum("n,ncm->cm", w, resp * live[:, :, None])
            acc[:, m] += (w[:, None] * live).sum(axis=0)
            acc[:, m + 1] += (w[:, None] * -np.log(np.maximum(dens, FLOOR))).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([acc.ravel()], pa.list_(pa.float64()))})
    return run


def basis_rows(cutoffs, rank: int, m: int) -> np.ndarray:
    """Coefficients in s of the m unit-mass basis functions of every cutoff (cutoff by cutoff)."""
    s_rows = bernstein_tail_coeffs(m)
    return np.vstack([s_rows / _basis_masses(s_rows, c, rank)[:, None] for c in cutoffs])


def em_features(split: DataFrame, cutoffs, rank: int, m: int) -> DataFrame:
    """``w, phi`` for every held-out vector of fit users: its weight in the objective and the array of
    the bases' mean values (zeros without a reference vector). Written: every step reads it again."""
    cutoffs = [float(c) for c in cutoffs]
    each = lambda f: [f(c) for c in cutoffs for _ in range(m)]
    fit = split.where(F.col("is_fit_user"))
    v = kde_arrays(fit, basis_rows(cutoffs, rank, m), each(lambda c: c), each(lambda c: c), each(lambda c: 1.0 - c), cap=True, strict=True)
    return _weighted(fit, v, len(cutoffs) * m)


def _weighted(fit: DataFrame, v: DataFrame, width: int) -> DataFrame:
    n_held = fit.where(~F.col("is_ref")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_held"))
    n_users = fit.select("user_id").distinct().count()
    zeros = F.array_repeat(F.lit(0.0), width)
    return blocks.written(v.join(n_held, "user_id").select(
        (F.lit(1.0) / (F.col("n_held") * F.lit(float(max(n_users, 1))))).alias("w"), F.coalesce("values", zeros).alias("phi")), "em-features")


def em_step(feats: DataFrame, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One aggregate job: the EM update of the weights ``pi`` (cutoffs x bases) and the objective at ``pi``.
    Every task adds its rows to one array; the driver adds one array for each task."""
    nc, m = pi.shape
    partial = feats.mapInArrow(_em_step_kernel(pi), "sums array<double>").collect()
    tot = sum((np.array(r.sums) for r in partial), np.zeros(nc * (m + 2))).reshape(nc, m + 2)
    live = tot[:, m:m + 1]
    return np.where(live > 0, tot[:, :m] / np.where(live > 0, live, 1.0), pi), tot[:, m + 1]


def em_steps(split: DataFrame, cutoffs, rank: int, m: int = 12, steps: int = 2) -> DataFrame:
    """``step, cutoff, weights, objective``: plain EM from equal weights; the weights after each step and
    the objective before it."""
    ship_package(split.sparkSession)
    feats = em_features(split, cutoffs, rank, m)
    pi, rows = np.full((len(cutoffs), m), 1.0 / m), []
    for k in range(1, steps + 1):
        pi, f = em_step(feats, pi)
        rows += [(k, float(c), [float(x) for x in pi[i]], float(f[i])) for i, c in enumerate(cutoffs)]
    return split.sparkSession.createDataFrame(rows, "step int, cutoff double, weights array<double>, objective double")


def fit_kernels(split: DataFrame, cutoffs, rank: int, m: int = 12, steps: int = 100,
                tol: float = 1e-5) -> list[dict]:
    """M9 (re-aimed): EM for the weights of a mixture of unit-mass monotone bases, all
    cutoffs at once (one aggregate per EM step covers every cutoff).

    Per cutoff returns ``cutoff, coeffs`` (monomial in t, low order first), ``weights``,
    ``train_nll`` (objective with the reference's user weighting) and ``history``
    (objective per accepted step; never increases). EM is accelerated with SQUAREM;
    ``steps`` bounds the number of aggregate jobs. A held-out vector with no reference
    vector above the cutoff has density 0 for every weight choice: it keeps the 1e-10
    floor in the objective and is left out of the M step."""
    cutoffs = [float(c) for c in cutoffs]
    nc = len(cutoffs)
    rows = basis_rows(cutoffs, rank, m).reshape(nc, m, -1)
    feats = em_features(split, cutoffs, rank, m)
    # partitions sized by rows: the EM loop runs one job per step over this table
    feats = feats.coalesce(max(1, -(-feats.count() // 1_000_000))).cache()

    def em(pi: np.ndarray):
        return em_step(feats, pi)

    # SQUAREM: two EM maps, a squared extrapolation, accepted only when its objective
    # is no worse than the plain EM step's, so the recorded objective never rises.
    pi0 = np.full((nc, m), 1.0 / m)
    upd0, f0 = em(pi0)
    history: list[list[float]] = [[float(f0[i])] for i in range(nc)]
    done = np.zeros(nc, dtype=bool)
    evals = 1
    while evals < steps and not done.all():
        pi1 = upd0
        pi2, f1 = em(pi1)
        r = pi1 - pi0
        v = pi2 - pi1 - r
        nr, nv = np.linalg.norm(r, axis=1), np.linalg.norm(v, axis=1)
        alpha = np.minimum(np.where(nv > 0, -nr / np.where(nv > 0, nv, 1.0), -1.0), -1.0)
        pip = pi0 - 2 * alpha[:, None] * r + (alpha ** 2)[:, None] * v
        pip = np.maximum(pip, 0.0)
        pip = pip / np.where(pip.sum(axis=1, keepdims=True) > 0, pip.sum(axis=1, keepdims=True), 1.0)
        updp, fp = em(pip)
        evals += 2
        ok = fp <= f1
        new_pi = np.where(ok[:, None], pip, pi2)
        new_upd, new_f = updp.copy(), fp.copy()
        if (~ok).any():
            upd2, f2 = em(pi2)
            evals += 1
            new_upd[~ok], new_f[~ok] = upd2[~ok], f2[~ok]
        # both candidates are no worse than EM(pi0), which is no worse than pi0
        for i in range(nc):
            if done[i]:
                continue
            history[i].append(float(new_f[i]))
            if f0[i] - new_f[i] <= tol * max(abs(new_f[i]), 1.0):
                done[i] = True
        pi0, upd0, f0 = new_pi, new_upd, new_f
    pi = pi0
    feats.unpersist()
    out = []
    for i, c in enumerate(cutoffs):
        coeffs = s_to_t(pi[i] @ rows[i], c)
        out.append({"cutoff": c, "coeffs": [float(x) for x in coeffs], "weights": [float(p) for p in pi[i]],
                    "train_nll": history[i][-1], "history": history[i]})
    return out


def fit_kernel(split: DataFrame, cutoff: float, rank: int, m: int = 12, steps: int = 100,
               tol: float = 1e-5) -> dict:
    """M9 for one cutoff."""
    return fit_kernels(split, [cutoff], rank, m, steps, tol)[0]


# ------------------------------------------------------------------ polynomial fit (barrier)

# Fixed values that define results: value at the cutoff, least slope.
AT_CUTOFF, SLOPE = 1e-5, 1e-4
#: Points of [c, 1] where the barrier holds the slope, and the weights the barrier falls through.
BARRIER_POINTS = 1024
BARRIER = tuple(10.0 ** -k for k in range(2, 8))


def _newton_sums(points: np.ndarray):
    """One array per task: for each (cutoff, point) the objective, its gradient and Hessian."""
    nc, n, k = points.shape

    def run(batches):
        acc = np.zeros((nc, n, 1 + k + k * k))
        for b in batches:
            if not b.num_rows:
                continue
            w = b.column("w").to_numpy()
            phi = b.column("phi").flatten().to_numpy(zero_copy_only=False).reshape(-1, nc, k)
            for j in range(n):
                dens = np.einsum("nck,ck->nc", phi, points[:, j])
                live = dens > FLOOR
                r = phi / np.where(live, dens, 1.0)[:, :, None] * live[:, :, None]
                acc[:, j, 0] += (w[:, None] * -np.log(np.maximum(dens, FLOOR))).sum(axis=0)
                acc[:, j, 1:1 + k] -= np.einsum("n,nck->ck", w, r)
                acc[:, j, 1 + k:] += np.einsum("nck,ncl->ckl", r * w[:, None, None], r).reshape(nc, -1)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([acc.ravel()], pa.list_(pa.float64()))})
    return run


def newton_sums(feats: DataFrame, points: np.ndarray) -> np.ndarray:
    """``_newton_sums`` added over the tasks (one array for each)."""
    nc, n, k = points.shape
    partial = feats.mapInArrow(_newton_sums(points), "sums array<double>").collect()
    return sum((np.array(r.sums) for r in partial), np.zeros(nc * n * (1 + k + k * k))).reshape(nc, n, -1)


class _Polynomials:
    """Constraints of one cutoff, in Chebyshev coefficients: value at the cutoff and mass (equalities),
    slopes at the barrier's points."""

    def __init__(self, cutoff: float, rank: int, degree: int, points: int = 20_000):
        cheb = np.polynomial.chebyshev
        h = (1.0 - cutoff) / points
        t = cutoff + (np.arange(points) + 0.5) * h
        mass = ((1.0 - t * t) ** ((rank - 3) / 2.0) * h * sphere_area(rank - 1)) @ cheb.chebvander(t, degree)
        self.equal = np.stack([cheb.chebvander(np.array([cutoff]), degree)[0], mass])
        grid = cutoff + (1.0 - cutoff) * (1.0 - np.cos(np.pi * np.arange(BARRIER_POINTS) / (BARRIER_POINTS - 1))) / 2.0
        self.slope = np.stack([cheb.chebval(grid, cheb.chebder(np.eye(degree + 1)[k])) for k in range(degree + 1)], axis=1)
        self.free = np.linalg.svd(self.equal)[2][2:].T  # directions that keep the equalities
        # the straight line of unit mass: strictly inside
        beta = (1.0 - AT_CUTOFF * mass[0]) / (mass[1] - cutoff * mass[0])
        self.start = np.zeros(degree + 1)
        self.start[:2] = AT_CUTOFF - beta * cutoff, beta

    def room(self, a: np.ndarray) -> np.ndarray:
        return self.slope @ a - SLOPE


def fit_polynomials(split: DataFrame, cutoffs, rank: int, degree: int = 5, steps: int = 80, tol: float = 1e-7) -> list[dict]:
    """M9 in the reference's family, all cutoffs at once: per cutoff ``cutoff, coeffs`` (monomial, low order
    first), ``train_nll, min_slope, converged``. A Newton step takes one aggregate job, with the sums at
    several points along the step; the farthest is taken at which the slopes stay inside and the barrier
    function falls enough. ``converged``: the last barrier's Newton decrement is below ``tol`` (or below 100 ``tol``
    where no step along it lowers the sum any more) within ``steps``."""
    ship_package(split.sparkSession)
    cutoffs = [float(c) for c in cutoffs]
    nc, k = len(cutoffs), degree + 1
    fit = split.where(F.col("is_fit_user"))
    rows, cs = np.tile(chebyshev_coeffs(degree), (nc, 1)), [c for c in cutoffs for _ in range(k)]
    feats = _weighted(fit, kde_arrays(fit, rows, cs, cap=True, strict=True), nc * k)
    feats = feats.coalesce(max(1, -(-feats.count() // 1_000_000))).cache()
    poly = [_Polynomials(c, rank, degree) for c in cutoffs]
    a = np.stack([p.start for p in poly])
    level, settled, taken = np.zeros(nc, int), np.zeros(nc, bool), 0
    sizes = 0.4 ** np.arange(9)
    sums = newton_sums(feats, a[:, None, :])[:, 0]
    while taken < steps and not settled.all():
        taken += 1
        moves, falls, now = np.zeros((nc, k)), np.zeros(nc), np.zeros(nc)
        for i, p in enumerate(poly):
            mu, room = BARRIER[level[i]], p.room(a[i])
            grad = p.free.T @ (sums[i, 1:1 + k] - mu * (p.slope / room[:, None]).sum(axis=0))
            s = p.slope @ p.free / room[:, None]
            hess = p.free.T @ sums[i, 1 + k:].reshape(k, k) @ p.free + mu * s.T @ s
            z = -np.linalg.solve(hess + 1e-12 * np.trace(hess) * np.eye(len(hess)), grad)
            moves[i], falls[i], now[i] = p.free @ z, -grad @ z, sums[i, 0] - mu * np.log(room).sum()
        tried = a[:, None, :] + sizes[None, :, None] * moves[:, None, :]
        found = newton_sums(feats, tried)
        for i, p in enumerate(poly):
            if settled[i]:
                continue
            room = np.stack([p.room(x) for x in tried[i]])
            merit = found[i, :, 0] - BARRIER[level[i]] * np.log(np.where(room > 0, room, 1.0)).sum(axis=1)
            good = np.flatnonzero((room > 0).all(axis=1) & (merit <= now[i] - 1e-4 * sizes * falls[i]))
            if len(good):
                a[i], sums[i] = tried[i, good[0]], found[i, good[0]]
            last = level[i] == len(BARRIER) - 1
            if last:
                settled[i] = falls[i] < tol or (not len(good) and falls[i] < 100 * tol)  # no step that rounding shows
            elif falls[i] < 1e-3 or not len(good):
                level[i] += 1
    nll = sums[:, 0]
    feats.unpersist()
    cheb, out = np.polynomial.chebyshev, []
    for i, c in enumerate(cutoffs):
        slope = np.polynomial.Polynomial(cheb.cheb2poly(cheb.chebder(a[i])))
        turns = [x.real for x in slope.deriv().roots() if abs(x.imag) < 1e-9 and c < x.real < 1.0]
        out.append({"cutoff": c, "coeffs": [float(x) for x in cheb.cheb2poly(a[i])], "train_nll": float(nll[i]),
                    "min_slope": float(min(slope(x) for x in (c, 1.0, *turns))), "converged": bool(settled[i])})
    return out


def polynomial_sweep(split: DataFrame, cutoffs, rank: int, degree: int = 5) -> DataFrame:
    """M12 over ``fit_polynomials``: ``cutoff, coeffs, train_nll, test_nll, mass, min_g, min_slope, converged,
    accepted``. The least slope is found at its stationary points."""
    spark = split.sparkSession
    fits = fit_polynomials(split, cutoffs, rank, degree)
    kernels = [(f["cutoff"], f["coeffs"]) for f in fits]
    test = {r["cutoff"]: r["nll"] for r in kde_nll(split, kernels, users="test").collect()}
    mass = {r["cutoff"]: r["mass"] for r in kernel_mass(spark, kernels, rank).collect()}
    mins = {r["cutoff"]: r["min_g"] for r in kernel_min(spark, kernels).collect()}
    rows = [(f["cutoff"], f["coeffs"], f["train_nll"], test.get(f["cutoff"]), mass[f["cutoff"]], mins[f["cutoff"]], f["min_slope"],
             f["converged"], abs(mass[f["cutoff"]] - 1.0) <= 0.1 and f["min_slope"] >= 0.0) for f in fits]
    return spark.createDataFrame(rows, "cutoff double, coeffs array<double>, train_nll double, test_nll double, mass double, "
                                       "min_g double, min_slope double, converged boolean, accepted boolean")


def kernel_sweep(split: DataFrame, cutoffs, rank: int, m: int = 12, steps: int = 100) -> DataFrame:
    """Per cutoff fit, check (mass, minimum) and train / test loss:
    ``cutoff, coeffs, train_nll, test_nll, mass, min_g, accepted``."""
    spark = split.sparkSession
    fits = fit_kernels(split, cutoffs, rank, m, steps)
    kernels = [(f["cutoff"], f["coeffs"]) for f in fits]
    test = {r["cutoff"]: r["nll"] for r in kde_nll(split, kernels, users="test").collect()}
    mass = {r["cutoff"]: r["mass"] for r in kernel_mass(spark, kernels, rank).collect()}
    mins = {r["cutoff"]: r["min_g"] for r in kernel_min(spark, kernels).collect()}
    rows = []
    for f in fits:
        c = f["cutoff"]
        ok = abs(mass[c] - 1.0) <= 0.1 and (mins[c] is None or mins[c] > -1e-3)
        rows.append((c, f["coeffs"], f["train_nll"], test.get(c), mass[c], mins[c], ok))
    schema = ("cutoff double, coeffs array<double>, train_nll double, test_nll double, mass double, "
              "min_g double, accepted boolean")
    return spark.createDataFrame(rows, schema)
