"""DuckDB SQL that recomputes each registered query from the raw tables.

The oracle follows the reference semantics directly (cross products, per-pair sums),
so it is an independent check of the Spark plans, which avoid those shapes.
"""

from __future__ import annotations

from ratinglab.functions.rng import sql_hash_normal, sql_hash_uniform
from ratinglab.plans import params as P
from ratinglab.operators.kernel import basis_rows
from ratinglab.operators.similarity import lsh_draws, sql_lsh_key
from ratinglab.sources.fixtures import EMBEDDING_DIM, sql_item_vectors, sql_items, sql_ratings

R6 = 6  # float outputs are rounded to 6 decimals on both sides


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"


def _histogram_cte(seed: int) -> str:
    v = (f"CASE WHEN rating >= {P.MIN_RATING!r} THEN CAST(floor(rating + "
         f"{sql_hash_normal(seed, 'noise', 'user_id', 'item_id')} * {P.NOISE_SD!r} + 0.5) AS BIGINT) END")
    buckets = ", ".join(f"count(CASE WHEN v = {k} THEN 1 END) AS c{k}" for k in range(1, 6))
    return (
        "SELECT item_id, count(*) AS n_raw, count(v) AS n_kept, " + buckets + ", "
        "CAST(coalesce(sum(v), 0) AS BIGINT) AS sum_r, CAST(coalesce(sum(v * v), 0) AS BIGINT) AS sum_r2 "
        f"FROM (SELECT item_id, {v} AS v FROM ratings) GROUP BY item_id"
    )


def _pmf_cte() -> str:
    ps = ", ".join(f"(c{k} + 1)::DOUBLE / (n_kept + 5.0) AS p{k}" for k in range(1, 6))
    return f"SELECT item_id, {ps} FROM histogram"


def _pmf_mean(prefix: str = "p") -> str:
    return "(" + " + ".join(f"{prefix}{k} * {k}.0" for k in range(1, 6)) + ")"


def _pmf_std(prefix: str = "p", mean: str | None = None) -> str:
    m = mean or _pmf_mean(prefix)
    return "sqrt(" + " + ".join(f"{prefix}{k} * ({k}.0 - {m}) * ({k}.0 - {m})" for k in range(1, 6)) + ")"


BASE = [("ratings", sql_ratings())]


def stats_sql() -> dict[str, str]:
    seed = P.SEED
    hist = BASE + [("histogram", _histogram_cte(seed))]
    q: dict[str, str] = {}
    q["ratings"] = _with(*BASE) + "SELECT user_id, item_id, rating, ts FROM ratings"
    q["items"] = _with(("items", sql_items())) + "SELECT item_id, title FROM items"
    q["item_vectors"] = _with(*BASE) + (
        f"SELECT item_id, list_transform(item_vector, lambda x: round(x, {R6})) AS item_vector, "
        f"round(mean, {R6}) AS mean, round(std, {R6}) AS std FROM ({sql_item_vectors()})")
    q["item_counts"] = _with(*BASE) + "SELECT item_id, count(*) AS n_raw FROM ratings GROUP BY item_id"
    q["user_counts"] = _with(*BASE) + "SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id"
    q["trusted_items"] = _with(*BASE) + (
        f"SELECT item_id, count(*) AS n_raw FROM ratings GROUP BY item_id HAVING count(*) > {P.TRUSTED_MIN}")
    q["trusted_ratings"] = _with(*BASE) + (
        "SELECT item_id, user_id, rating, ts FROM ratings WHERE item_id IN ("
        f"SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) > {P.TRUSTED_MIN})")
    q["clean_ratings"] = _with(*BASE) + (
        f"SELECT user_id, item_id, rating, ts FROM ratings WHERE rating >= {P.MIN_RATING!r}")
    q["noisy_ratings"] = _with(*BASE) + (
        "SELECT user_id, item_id, rating, CAST(floor(rating + "
        f"{sql_hash_normal(seed, 'noise', 'user_id', 'item_id')} * {P.NOISE_SD!r} + 0.5) AS BIGINT) AS v "
        f"FROM ratings WHERE rating >= {P.MIN_RATING!r}")
    q["item_histogram"] = _with(*hist) + "SELECT * FROM histogram"
    q["item_pmf"] = _with(*hist, ("pmf", _pmf_cte())) + "SELECT * FROM pmf"
    q["pmf_moments"] = _with(*hist, ("pmf", _pmf_cte())) + (
        f"SELECT item_id, round({_pmf_mean()}, {R6}) AS mean, round({_pmf_std()}, {R6}) AS std FROM pmf")
    q["item_moments"] = _with(*hist) + (
        f"SELECT item_id, round(mean, {R6}) AS mean, round(sqrt(greatest(var, 0.0)), {R6}) AS std FROM ("
        "SELECT item_id, CASE WHEN n_kept > 0 THEN sum_r::DOUBLE / n_kept END AS mean, "
        "CASE WHEN n_kept > 0 THEN sum_r2::DOUBLE / n_kept - (sum_r::DOUBLE / n_kept) * (sum_r::DOUBLE / n_kept) END AS var "
        "FROM histogram)")
    q["rated_items"] = _with(*BASE) + "SELECT DISTINCT item_id FROM ratings"
    q["hash_split"] = _with(*BASE) + (
        f"SELECT user_id, item_id, rating, {sql_hash_uniform(seed, 'split', 'user_id', 'item_id')} "
        f"< {P.TRAIN_RATIO!r} AS is_train FROM ratings")
    return q


def _priors_cte(trusted_min: int) -> str:
    return (f"SELECT p.item_id AS prior_id, p1, p2, p3, p4, p5, {_pmf_mean()} AS mean_q, {_pmf_std()} AS std_q "
            f"FROM pmf p JOIN histogram h ON h.item_id = p.item_id WHERE h.n_raw > {trusted_min}")


def _alpha_expr() -> str:
    n = "(c1 + c2 + c3 + c4 + c5)"
    return "(" + " + ".join(
        f"CASE WHEN c{k} = 0 THEN 0.0 ELSE c{k} * ln(p{k} * {n} / c{k}) END" for k in range(1, 6)) + ")"


def _post_cte() -> str:
    """Reference form: every cold histogram against every prior, weights exp(alpha)."""
    return (
        "SELECT c1, c2, c3, c4, c5, sum(w) AS sum_w, sum(w * mean_q) AS sum_wm, sum(w * std_q) AS sum_ws, "
        "count(*) AS n_q FROM (SELECT c.*, q.mean_q, q.std_q, exp(" + _alpha_expr() + ") AS w "
        "FROM cold c CROSS JOIN priors q) GROUP BY c1, c2, c3, c4, c5")


def _stats_raw() -> str:
    return (
        "SELECT h.item_id, (h.n_raw < " + str(P.SAMPLE_MIN) + " OR h.n_kept = 0) AS cold, "
        "((h.n_raw < " + str(P.SAMPLE_MIN) + " OR h.n_kept = 0) AND p.sum_w > 0 AND "
        f"(p.sum_w / p.n_q) * {float(P.MAX_ITER)!r} >= 1.0) AS use_post, "
        "p.sum_wm / p.sum_w AS post_mean, p.sum_ws / p.sum_w AS post_std, "
        "CASE WHEN h.n_kept > 0 THEN h.sum_r::DOUBLE / h.n_kept END AS s_mean, "
        "sqrt(greatest(CASE WHEN h.n_kept > 0 THEN h.sum_r2::DOUBLE / h.n_kept - "
        "(h.sum_r::DOUBLE / h.n_kept) * (h.sum_r::DOUBLE / h.n_kept) END, 0.0)) AS s_std "
        "FROM histogram h LEFT JOIN post p USING (c1, c2, c3, c4, c5)")


def posterior_base() -> list[tuple[str, str]]:
    seed = P.SEED
    return BASE + [("histogram", _histogram_cte(seed)), ("pmf", _pmf_cte()),
                   ("priors", _priors_cte(P.TRUSTED_MIN)),
                   ("cold", f"SELECT DISTINCT c1, c2, c3, c4, c5 FROM histogram "
                            f"WHERE n_raw < {P.SAMPLE_MIN} OR n_kept = 0"),
                   ("post", _post_cte()), ("stats_raw", _stats_raw())]


def posterior_sql() -> dict[str, str]:
    seed = P.SEED
    base = BASE + [("histogram", _histogram_cte(seed)), ("pmf", _pmf_cte()),
                   ("priors", _priors_cte(P.TRUSTED_MIN)),
                   ("cold", f"SELECT DISTINCT c1, c2, c3, c4, c5 FROM histogram "
                            f"WHERE n_raw < {P.SAMPLE_MIN} OR n_kept = 0"),
                   ("post", _post_cte())]
    q: dict[str, str] = {}
    q["posterior_weights"] = _with(*base) + (
        f"SELECT c1, c2, c3, c4, c5, round(sum_w, {R6}) AS sum_w, round(sum_wm, {R6}) AS sum_wm, "
        f"round(sum_ws, {R6}) AS sum_ws, n_q FROM post")
    q["expected_proposals"] = _with(*base) + (
        f"SELECT c1, c2, c3, c4, c5, round(least({float(P.ACCEPTS)!r} / (sum_w / n_q), {float(P.MAX_ITER)!r}), "
        f"{R6}) AS expected_proposals FROM post")
    u = sql_hash_uniform(P.SEED, "post", "dr.item_id", "dr.draw")
    q["posterior_sample"] = _with(*base, (
        "coldi", f"SELECT item_id, c1, c2, c3, c4, c5 FROM histogram WHERE n_raw < {P.SAMPLE_MIN} OR n_kept = 0"), (
        "ww", "SELECT c.item_id, q.prior_id, exp(" + _alpha_expr() + ") AS w FROM coldi c CROSS JOIN priors q"), (
        "cum", "SELECT item_id, prior_id, sum(w) OVER (PARTITION BY item_id ORDER BY prior_id "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum(w) OVER (PARTITION BY item_id) AS wt "
               "FROM ww"), (
        "dr", f"SELECT item_id, unnest(range(1, {P.ACCEPTS + 1})) AS draw FROM coldi"), (
        "tg", f"SELECT dr.item_id, dr.draw, {u} * x.wt AS target FROM dr "
              "JOIN (SELECT DISTINCT item_id, wt FROM cum) x ON x.item_id = dr.item_id")) + (
        "SELECT t.item_id, CAST(t.draw AS INTEGER) AS draw, min(c.prior_id) AS prior_id FROM tg t "
        "JOIN cum c ON c.item_id = t.item_id AND c.hi > t.target GROUP BY t.item_id, t.draw")
    q["posterior_moments"] = _with(*base) + (
        f"SELECT c1, c2, c3, c4, c5, round(sum_wm / sum_w, {R6}) AS mean, round(sum_ws / sum_w, {R6}) AS std, "
        f"round(least({float(P.ACCEPTS)!r} / (sum_w / n_q), {float(P.MAX_ITER)!r}), {R6}) AS expected_proposals, "
        "n_q FROM post")
    q["item_stats"] = _with(*posterior_base()) + (
        "SELECT item_id, round(CASE WHEN use_post THEN post_mean ELSE s_mean END, 6) AS mean, "
        "round(CASE WHEN use_post THEN (CASE WHEN post_std = 0 THEN 1e-9 ELSE post_std END) ELSE s_std END, 6) AS std, "
        "CASE WHEN NOT cold THEN 'plain' WHEN use_post THEN 'posterior' ELSE 'fallback' END AS source FROM stats_raw")
    return q




# ------------------------------------------------------------------ vectors, ridge, inference

def _iv_ctes(rank: int | None = P.RANK) -> list[tuple[str, str]]:
    return BASE + [("iv", sql_item_vectors(rank)),
                   ("rwv", "SELECT r.user_id, r.item_id, r.rating, v.item_vector, v.mean, v.std "
                           "FROM ratings r JOIN iv v ON v.item_id = r.item_id"),
                   ("nv", "SELECT item_id, item_vector, mean, std, list_transform(item_vector, lambda x: x / "
                          "sqrt(list_dot_product(item_vector, item_vector))) AS unit FROM iv "
                          "WHERE list_dot_product(item_vector, item_vector) > 0")]


def _gram_cte(rank: int) -> str:
    xs = ", ".join(f"item_vector[{i + 1}] AS x{i}" for i in range(rank))
    sums = ["count(*) AS n"]
    sums += [f"sum(x{i} * x{j}) AS a_{i}_{j}" for i in range(rank) for j in range(i, rank)]
    sums += [f"sum(x{i} * z) AS b_{i}" for i in range(rank)]
    sums += [f"sum(x{i}) AS s_{i}" for i in range(rank)]
    sums += ["sum(z) AS sy", "sum(z * z) AS syy"]
    return (f"SELECT user_id, {', '.join(sums)} FROM (SELECT user_id, {xs}, "
            "CASE WHEN std = 0 THEN rating - mean ELSE (rating - mean) / std END AS z FROM rwv) GROUP BY user_id")


def _cholesky_ctes(prev: str, rank: int, tag: str) -> tuple[list[tuple[str, str]], str]:
    """Unrolled Cholesky solve: ``prev`` has m_i_j (upper triangle) and r_i; the last CTE, whose name is
    returned too, adds x_i."""
    ctes = []

    def mm(i, j):
        return f"m_{min(i, j)}_{max(i, j)}"
    for j in range(rank):
        diag = f"sqrt({mm(j, j)}" + "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j)) + ")"
        ctes.append((f"chd{tag}{j}", f"SELECT *, {diag} AS l_{j}_{j} FROM {prev}"))
        prev = f"chd{tag}{j}"
        if j + 1 < rank:
            cols = ", ".join(
                f"({mm(i, j)}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j)) + f") / l_{j}_{j} AS l_{i}_{j}"
                for i in range(j + 1, rank))
            ctes.append((f"chl{tag}{j}", f"SELECT *, {cols} FROM {prev}"))
            prev = f"chl{tag}{j}"
    for i in range(rank):
        e = f"(r_{i}" + "".join(f" - l_{i}_{k} * y_{k}" for k in range(i)) + f") / l_{i}_{i}"
        ctes.append((f"fw{tag}{i}", f"SELECT *, {e} AS y_{i} FROM {prev}"))
        prev = f"fw{tag}{i}"
    for i in reversed(range(rank)):
        e = f"(y_{i}" + "".join(f" - l_{k}_{i} * x_{k}" for k in range(i + 1, rank)) + f") / l_{i}_{i}"
        ctes.append((f"bk{tag}{i}", f"SELECT *, {e} AS x_{i} FROM {prev}"))
        prev = f"bk{tag}{i}"
    return ctes, prev


def _sweep_ctes(rank: int, reg: float, sweeps: int, seed: int) -> list[tuple[str, str]]:
    """Alternating half-sweeps, each a group of normal equations and its unrolled solution."""
    start = ", ".join(f"{sql_hash_uniform(seed, f'als{j}', 'item_id')} AS x_{j}" for j in range(rank))
    ctes, prev = [("als0", f"SELECT item_id AS id, {start} FROM (SELECT DISTINCT item_id FROM ratings)")], "als0"
    for k in range(2 * sweeps):
        key, other = ("user_id", "item_id") if k % 2 == 0 else ("item_id", "user_id")
        m = [f"sum(x_{i} * x_{j})" + (f" + {reg!r} * count(*)" if i == j else "") + f" AS m_{i}_{j}" for i in range(rank) for j in range(i, rank)]
        r = [f"sum(x_{i} * rating) AS r_{i}" for i in range(rank)]
        ctes.append((f"eq{k}", f"SELECT r.{key} AS id, {', '.join(m + r)} FROM ratings r JOIN {prev} f ON f.id = r.{other} GROUP BY r.{key}"))
        solved, last = _cholesky_ctes(f"eq{k}", rank, f"{k}_")
        prev = f"als{k + 1}"
        ctes += solved + [(prev, f"SELECT id, {', '.join(f'x_{i}' for i in range(rank))} FROM {last}")]
    return ctes


def _ridge_ctes(rank: int, reg: float) -> list[tuple[str, str]]:
    """Unrolled Cholesky solve of (X'X/n + reg/sd_y diag(var_x)) beta = X'y/n per user."""
    m = []
    for i in range(rank):
        for j in range(i, rank):
            e = f"a_{i}_{j} / n"
            if i == j:
                e += f" + ({reg!r} / sd_y) * greatest(a_{i}_{i} / n - (s_{i} / n) * (s_{i} / n), 0.0)"
            m.append(f"{e} AS m_{i}_{j}")
    rhs = [f"b_{i} / n AS r_{i}" for i in range(rank)]
    ctes = [("sys0", "SELECT *, (syy / n - (sy / n) * (sy / n)) <= 1e-12 * greatest(syy / n, 2.2250738585072014e-308) "
                     "AS degenerate FROM gram"),
            ("sys1", "SELECT *, sqrt(CASE WHEN degenerate THEN 1.0 ELSE syy / n - (sy / n) * (sy / n) END) AS sd_y "
                     "FROM sys0"),
            ("sys2", f"SELECT user_id, degenerate, {', '.join(m + rhs)} FROM sys1")]
    solved, prev = _cholesky_ctes("sys2", rank, "")
    ctes += solved
    us = ", ".join(f"CASE WHEN degenerate THEN 0.0 ELSE x_{i} END AS u{i}" for i in range(rank))
    ctes.append(("uvec", f"SELECT user_id, degenerate, {us} FROM {prev}"))
    return ctes


def _g_sql(t: str) -> str:
    from ratinglab.functions.scoring import INFERENCE_KERNEL
    acc = f"{INFERENCE_KERNEL[-1]!r}"
    for c in reversed(INFERENCE_KERNEL[:-1]):
        acc = f"({acc} * {t} + {c!r})"
    return acc


def _pdf_ctes(cutoff: float) -> list[tuple[str, str]]:
    return [("cnt", "SELECT user_id, count(*) AS n_u FROM rwv GROUP BY user_id"),
            ("pairs", "SELECT rw.user_id, c.item_id, list_dot_product(a.unit, c.unit) AS d "
                      "FROM rwv rw JOIN nv a ON a.item_id = rw.item_id CROSS JOIN nv c"),
            ("pdfs", f"SELECT user_id, item_id, sum({_g_sql('d')}) AS gs FROM pairs WHERE d >= {cutoff!r} "
                     "GROUP BY user_id, item_id")]


def vectors_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    rank, reg = P.RANK, P.RIDGE_REG
    ivc, whole = _iv_ctes(), _iv_ctes(None)
    q["ratings_with_vectors"] = _with(*whole) + (
        f"SELECT user_id, item_id, rating, list_transform(item_vector, lambda x: round(x, {R6})) AS item_vector, "
        f"round(mean, {R6}) AS mean, round(std, {R6}) AS std FROM rwv")
    q["similar_items_exact"] = _with(*whole) + (
        f"SELECT left_id, right_id, round(d, {R6}) AS dot FROM (SELECT a.item_id AS left_id, b.item_id AS right_id, "
        f"list_dot_product(a.unit, b.unit) AS d FROM nv a CROSS JOIN nv b) WHERE d > {P_CUTOFF!r}")
    keys = lsh_draws(EMBEDDING_DIM, P.LSH_TABLES)
    columns = ", ".join(f"{sql_lsh_key('unit', *d, P.LSH_WIDTH)} AS k{t}_{i}" for t, key in enumerate(keys) for i, d in enumerate(key))
    same = " OR ".join("(" + " AND ".join(f"a.k{t}_{i} = b.k{t}_{i}" for i in range(len(key))) + ")" for t, key in enumerate(keys))
    q["similar_items_lsh"] = _with(*whole, ("nk", f"SELECT item_id, unit, {columns} FROM nv")) + (
        f"SELECT left_id, right_id, round(d, {R6}) AS dot FROM (SELECT a.item_id AS left_id, b.item_id AS right_id, "
        f"list_dot_product(a.unit, b.unit) AS d FROM nk a CROSS JOIN nk b WHERE {same}) WHERE d > {P_CUTOFF!r}")
    q["user_gram"] = _with(*ivc, ("gram", _gram_cte(rank))) + (
        "SELECT user_id, n, "
        "[" + ", ".join(f"round(a_{i}_{j}, {R6})" for i in range(rank) for j in range(i, rank)) + "] AS xtx, "
        "[" + ", ".join(f"round(b_{i}, {R6})" for i in range(rank)) + "] AS xty, "
        "[" + ", ".join(f"round(s_{i}, {R6})" for i in range(rank)) + "] AS sx, "
        f"round(sy, {R6}) AS sy, round(syy, {R6}) AS syy FROM gram")
    q["user_vectors"] = _with(*ivc, ("gram", _gram_cte(rank)), *_ridge_ctes(rank, reg)) + (
        "SELECT user_id, [" + ", ".join(f"round(u{i}, {R6})" for i in range(rank)) + "] AS user_vector, "
        "degenerate FROM uvec")
    q["user_item_pdf"] = _with(*ivc, *_pdf_ctes(P_CUTOFF)) + (
        f"SELECT p.user_id, p.item_id, round(p.gs / c.n_u, {R6}) AS pdf FROM pdfs p JOIN cnt c USING (user_id) "
        "WHERE NOT EXISTS (SELECT 1 FROM rwv r WHERE r.user_id = p.user_id AND r.item_id = p.item_id)")
    for name, rounding in (("recommend", "literal"), ("recommend_half_star", "half_star")):
        du = " + ".join(f"u.u{i} * c.item_vector[{i + 1}]" for i in range(rank))
        if rounding == "literal":
            pred = "least(greatest(floor(floor(mean + std * du * 2.0 + 0.5) / 2.0), 1.0), 5.0)"
        else:
            pred = "least(greatest(floor((mean + std * du) * 2.0 + 0.5) / 2.0, 1.0), 5.0)"
        q[name] = _with(*ivc, ("gram", _gram_cte(rank)), *_ridge_ctes(rank, reg), *_pdf_ctes(P_CUTOFF),
                        ("items", sql_items()),
                        ("grid", f"SELECT u.user_id, c.item_id, c.mean, c.std, {du} AS du FROM uvec u CROSS JOIN nv c "
                                 "WHERE NOT EXISTS (SELECT 1 FROM rwv r WHERE r.user_id = u.user_id "
                                 "AND r.item_id = c.item_id)"),
                        ("scored", f"SELECT g.user_id, g.item_id, {pred} AS predicted, "
                                   "coalesce(p.gs / n.n_u, 0.0) AS pdf FROM grid g JOIN cnt n USING (user_id) "
                                   "LEFT JOIN pdfs p USING (user_id, item_id)"),
                        ("fin", f"SELECT user_id, item_id, predicted - {P.B!r} * ln(pdf + 1e-05) AS score FROM scored"),
                        ("ranked", "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, "
                                   "item_id) AS INTEGER) AS rank FROM fin")) + (
            "SELECT r.user_id, r.rank, r.item_id, coalesce(i.title, '?') AS title, "
            f"round(r.score, {R6}) AS score FROM ranked r LEFT JOIN items i ON i.item_id = r.item_id "
            f"WHERE r.rank <= {P.N_PICKS}")
    q["recommend_requested"] = q["recommend"] + (
        f" AND r.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = '{P.SEGMENT}')")
    du = " + ".join(f"u.u{i} * v.item_vector[{i + 1}]" for i in range(rank))
    # the reference's union of the pair sums with a zero row for every user and item
    whole_grid = _with(*ivc, ("gram", _gram_cte(rank)), *_ridge_ctes(rank, reg), *_pdf_ctes(P_CUTOFF),
                                  ("zeros", "SELECT user_id, item_id, gs FROM pdfs UNION ALL "
                                            "SELECT u.user_id, c.item_id, 0.0 AS gs FROM uvec u CROSS JOIN nv c"),
                                  ("cand", "SELECT z.user_id, z.item_id, sum(z.gs) / any_value(c.n_u) AS pdf FROM zeros z "
                                           "JOIN cnt c USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM rwv r WHERE "
                                           "r.user_id = z.user_id AND r.item_id = z.item_id) GROUP BY z.user_id, z.item_id"),
                                  ("pr", "SELECT c.user_id, c.item_id, c.pdf, least(greatest(floor(floor(v.mean + "
                                         f"v.std * ({du}) * 2.0 + 0.5) / 2.0), 1.0), 5.0) AS predicted "
                                         "FROM cand c JOIN uvec u ON u.user_id = c.user_id "
                                         "JOIN iv v ON v.item_id = c.item_id"),
                                  ("sc", f"SELECT *, predicted - {P.B!r} * ln(pdf + 1e-05) AS score FROM pr"))
    q["score_candidates"] = whole_grid + f"SELECT user_id, item_id, predicted, round(pdf, {R6}) AS pdf, round(score, {R6}) AS score FROM sc"
    q["candidate_totals"] = whole_grid + (
        "SELECT user_id, count(*) AS n_candidates, count(*) FILTER (pdf = 0) AS n_zero, "
        f"round(sum(pdf), {R6}) AS pdf_sum, round(max(score), {R6}) AS best_score FROM sc GROUP BY user_id")
    q["candidate_report"] = whole_grid + (
        f"SELECT user_id, rank, item_id, predicted, round(pdf, {R6}) AS pdf, round(score, {R6}) AS score, n_candidates, n_zero, "
        f"round(pdf_sum, {R6}) AS pdf_sum FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) "
        "AS INTEGER) AS rank, count(*) OVER (PARTITION BY user_id) AS n_candidates, count(*) FILTER (pdf = 0) OVER (PARTITION BY user_id) "
        f"AS n_zero, sum(pdf) OVER (PARTITION BY user_id) AS pdf_sum FROM sc) WHERE rank <= {P.N_PICKS}")
    xs = "[" + ", ".join(f"round(x_{i}, {R6})" for i in range(rank)) + "] AS factors"
    q["als_sweep"] = _with(*BASE, *_sweep_ctes(rank, P.ALS_REG, P.ALS_SWEEPS, P.SEED)) + (
        f"SELECT 'user' AS side, id, {xs} FROM als{2 * P.ALS_SWEEPS - 1} UNION ALL SELECT 'item' AS side, id, {xs} FROM als{2 * P.ALS_SWEEPS}")
    q["missing_users"] = _with(*whole) + (
        "SELECT DISTINCT CAST(c_custkey AS INTEGER) AS user_id FROM customer "
        "WHERE CAST(c_custkey AS INTEGER) NOT IN (SELECT user_id FROM rwv)")
    train = [(f"run{k}", "SELECT user_id, item_id, " + sql_hash_uniform(P.SEED + k - 1, "split", "user_id", "item_id")
              + f" < {P.TRAIN_RATIO!r} AS is_train FROM ratings") for k in (1, 2)]
    q["als_cold_start"] = _with(*BASE, *train) + " UNION ALL ".join(
        f"SELECT {k} AS run, count(*) AS n_test, count(*) FILTER (user_id IN (SELECT user_id FROM run{k} WHERE is_train) "
        f"AND item_id IN (SELECT item_id FROM run{k} WHERE is_train)) AS n_scored FROM run{k} WHERE NOT is_train" for k in (1, 2))
    return q


P_CUTOFF = 0.4


def normalize_sql() -> dict[str, str]:
    """z-scores against ``item_stats`` and the user-mean-z predictor's test MSE."""
    base = posterior_base()
    st = ("st", "SELECT item_id, CASE WHEN use_post THEN post_mean ELSE s_mean END AS mean, "
                "CASE WHEN use_post THEN (CASE WHEN post_std = 0 THEN 1e-9 ELSE post_std END) ELSE s_std END AS std "
                "FROM stats_raw")
    z = ("zs", "SELECT r.user_id, r.item_id, r.rating, CASE WHEN s.std = 0 THEN r.rating - s.mean "
               "ELSE (r.rating - s.mean) / s.std END AS z, s.mean, s.std, "
               f"{sql_hash_uniform(P.SEED, 'split', 'r.user_id', 'r.item_id')} < {P.TRAIN_RATIO!r} AS is_train "
               "FROM ratings r LEFT JOIN st s ON s.item_id = r.item_id")
    q: dict[str, str] = {}
    q["als_model_table"] = _with(*base, st, z) + (
        f"SELECT item_id, {P.RANK} AS n_components, round(mean, {R6}) AS mean, round(std, {R6}) AS std FROM st "
        "WHERE item_id IN (SELECT item_id FROM zs WHERE is_train AND z IS NOT NULL)")
    q["zscore_ratings"] = _with(*base, st, z) + (
        f"SELECT user_id, item_id, rating, round(z, {R6}) AS z, round(mean, {R6}) AS mean, round(std, {R6}) AS std "
        "FROM zs")
    q["zscore_mse"] = _with(*base, st, z, (
        "pred", "SELECT t.*, coalesce(u.pz, 0.0) AS prediction FROM (SELECT * FROM zs WHERE NOT is_train) t "
                "LEFT JOIN (SELECT user_id, avg(z) AS pz FROM zs WHERE is_train GROUP BY user_id) u "
                "ON u.user_id = t.user_id")) + (
        f"SELECT round(avg((rating - (prediction * std + mean)) * (rating - (prediction * std + mean))), {R6}) "
        "AS mse, count(*) AS n_scored FROM pred")
    return q




def study_sql() -> dict[str, str]:
    seed = P.SEED
    sizes = ", ".join(str(n) for n in P.STUDY_SIZES)
    cum = ["p1", "p1 + p2", "p1 + p2 + p3", "p1 + p2 + p3 + p4"]
    u = sql_hash_uniform(seed, "draw", "n", "item_id", "d")
    bucket = ("CASE " + " ".join(f"WHEN u <= ({c}) THEN {k}" for k, c in enumerate(cum, start=1)) + " ELSE 5 END")
    ctes = BASE + [
        ("histogram", _histogram_cte(seed)), ("pmf", _pmf_cte()),
        ("spmf", f"SELECT p.*, {sql_hash_uniform(seed, 'items', 'p.item_id')} < {P.TEST_RATIO!r} AS is_test, "
                 f"{_pmf_mean()} AS true_mean, {_pmf_std()} AS true_std FROM pmf p JOIN histogram h "
                 f"ON h.item_id = p.item_id WHERE h.n_raw > {P.TRUSTED_MIN}"),
        ("priors", "SELECT item_id AS prior_id, p1, p2, p3, p4, p5, true_mean AS mean_q, true_std AS std_q "
                   "FROM spmf WHERE NOT is_test"),
        ("tests", "SELECT * FROM spmf WHERE is_test"),
        ("grid", f"SELECT t.*, unnest([{sizes}]) AS n FROM tests t"),
        ("draws", "SELECT n, item_id, p1, p2, p3, p4, p5, unnest(range(1, n + 1)) AS d FROM grid"),
        ("buck", f"SELECT n, item_id, {bucket} AS b FROM (SELECT *, {u} AS u FROM draws)"),
        ("counts", "SELECT n, item_id, " + ", ".join(f"count(CASE WHEN b = {k} THEN 1 END) AS c{k}"
                                                     for k in range(1, 6)) + " FROM buck GROUP BY n, item_id"),
        ("cold", "SELECT DISTINCT c1, c2, c3, c4, c5 FROM counts"),
        ("post", _post_cte()),
        ("j", "SELECT c.n, c.item_id, t.true_mean, t.true_std, "
              "(c1 * 1 + c2 * 2 + c3 * 3 + c4 * 4 + c5 * 5)::DOUBLE / c.n AS sample_mean, "
              "sqrt(" + " + ".join(
                  f"c{k}::DOUBLE / c.n * ({k}.0 - hm) * ({k}.0 - hm)" for k in range(1, 6)) + ") AS sample_std, "
              "p.sum_wm / p.sum_w AS post_mean, p.sum_ws / p.sum_w AS post_std, "
              f"least({float(P.ACCEPTS)!r} / (p.sum_w / p.n_q), {float(P.MAX_ITER)!r}) AS expected_proposals "
              "FROM (SELECT *, (" + " + ".join(f"c{k}::DOUBLE / n * {k}.0" for k in range(1, 6)) + ") AS hm "
              "FROM counts) c JOIN tests t ON t.item_id = c.item_id "
              "LEFT JOIN post p USING (c1, c2, c3, c4, c5)"),
        ("errs", "SELECT n, item_id, 'mean' AS statistic, 'sample' AS estimator, sample_mean - true_mean AS err, "
                 "expected_proposals FROM j UNION ALL "
                 "SELECT n, item_id, 'mean', 'posterior', post_mean - true_mean, expected_proposals FROM j UNION ALL "
                 "SELECT n, item_id, 'std', 'sample', sample_std - true_std, expected_proposals FROM j UNION ALL "
                 "SELECT n, item_id, 'std', 'posterior', post_std - true_std, expected_proposals FROM j"),
    ]
    q: dict[str, str] = {}
    q["multinomial_counts"] = _with(*ctes) + "SELECT n, item_id, c1, c2, c3, c4, c5 FROM counts"
    q["study_errors"] = _with(*ctes) + (
        f"SELECT CAST(n AS INTEGER) AS n, item_id, statistic, estimator, round(err, {R6}) AS err, "
        f"round(expected_proposals, {R6}) AS expected_proposals FROM errs")
    q["study_mse"] = _with(*ctes) + (
        f"SELECT CAST(n AS INTEGER) AS n, statistic, estimator, round(avg(err * err), {R6}) AS mse FROM errs "
        "GROUP BY n, statistic, estimator")
    q["study_iterations"] = _with(*ctes) + (
        f"SELECT CAST(n AS INTEGER) AS n, round(avg(expected_proposals), {R6}) AS avg_proposals, "
        "CAST(floor(avg(expected_proposals) + 0.5) AS BIGINT) AS avg_proposals_rounded FROM j GROUP BY n")
    return q




def _kde_ctes(rank: int | None = P.RANK) -> list[tuple[str, str]]:
    seed = P.SEED
    return _iv_ctes(rank) + [
        ("topu", f"SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id ORDER BY n DESC, user_id "
                 f"LIMIT {P.N_USERS}"),
        ("vs", "SELECT r.user_id, CAST(row_number() OVER (PARTITION BY r.user_id ORDER BY r.item_id) AS INTEGER) "
               "AS pos, r.item_id, v.unit FROM ratings r JOIN nv v ON v.item_id = r.item_id "
               "WHERE r.user_id IN (SELECT user_id FROM topu)"),
        ("us", "SELECT user_id, row_number() OVER (ORDER BY "
               f"{sql_hash_uniform(seed, 'kuser', 'user_id')}, user_id) <= floor(count(*) OVER () * 4 / 5.0) "
               "AS is_fit_user FROM (SELECT DISTINCT user_id FROM vs)"),
        ("sp", "SELECT v.*, u.is_fit_user, CASE WHEN u.is_fit_user THEN row_number() OVER (PARTITION BY v.user_id "
               f"ORDER BY {sql_hash_uniform(seed, 'kfit', 'v.user_id', 'v.item_id')}, v.item_id) "
               "<= floor(count(*) OVER (PARTITION BY v.user_id) * 9 / 10.0) "
               "ELSE v.pos <= floor(count(*) OVER (PARTITION BY v.user_id) * 4 / 5.0) END AS is_ref "
               "FROM vs v JOIN us u ON u.user_id = v.user_id"),
        ("kp", "SELECT h.user_id, h.item_id, list_dot_product(h.unit, r.unit) AS d, "
               "h.is_fit_user FROM sp h JOIN sp r ON r.user_id = h.user_id AND r.is_ref WHERE NOT h.is_ref"),
    ]


def kernel_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    ctes = _kde_ctes()
    q["top_users"] = _with(*BASE) + (
        f"SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id ORDER BY n DESC, user_id LIMIT {P.N_USERS}")
    whole = _kde_ctes(None)
    q["read_vector_sets"] = _with(*whole) + (
        f"SELECT count(*) AS n_vectors, round(sum(list_sum(unit)), {R6}) AS total FROM vs GROUP BY user_id")
    q["vector_sets"] = _with(*whole) + (
        f"SELECT user_id, pos, item_id, list_transform(unit, lambda x: round(x, {R6})) AS unit_vector FROM vs")
    # Chebyshev features, reference form: mean over reference vectors of [d > c] T_k(d)
    cheb = {0: "1.0", 1: "d"}
    for k in range(2, 6):
        cheb[k] = f"(2.0 * d * {cheb[k - 1]} - {cheb[k - 2]})"
    sel = " UNION ALL ".join(
        f"SELECT user_id, item_id, {c!r} AS cutoff, {k} AS k, avg(CASE WHEN d > {c!r} THEN {cheb[k]} ELSE 0.0 END) "
        "AS phi FROM kp WHERE is_fit_user GROUP BY user_id, item_id" for c in P.KDE_CUTOFFS for k in range(6))
    q["kernel_features"] = _with(*ctes) + (
        f"SELECT user_id, item_id, cutoff, CAST(k AS INTEGER) AS k, round(phi, {R6}) AS phi FROM ({sel})")
    g = _g_sql("least(d, 1.0)")
    users = "(SELECT count(DISTINCT user_id) FROM sp WHERE NOT is_fit_user)"
    q["kde_nll"] = _with(*ctes) + " UNION ALL ".join(
        f"SELECT {c!r} AS cutoff, round(sum(user_nll) / {users}, "
        f"{R6}) AS nll FROM (SELECT user_id, avg(-ln(greatest(f, 1e-10))) AS user_nll FROM ("
        f"SELECT user_id, item_id, avg(CASE WHEN d > {c!r} THEN {g} ELSE 0.0 END) AS f FROM kp "
        "WHERE NOT is_fit_user GROUP BY user_id, item_id) GROUP BY user_id)" for c in P.KDE_CUTOFFS)
    q["kernel_em_step"] = _em_sql(ctes)
    return q


def _em_sql(ctes: list[tuple[str, str]]) -> str:
    """Two EM steps: every basis at every pair, means per held-out vector, responsibilities."""
    m, nc = P.EM_BASES, len(P.KDE_CUTOFFS)
    rows = basis_rows(P.KDE_CUTOFFS, P.RANK, m).reshape(nc, m, -1)

    def horner(coeffs):
        acc = repr(float(coeffs[-1]))
        for c in coeffs[-2::-1]:
            acc = f"({acc} * s + {float(c)!r})"
        return acc
    phi = " UNION ALL ".join(
        f"SELECT {c!r} AS cutoff, user_id, item_id, [" + ", ".join(
            f"avg(CASE WHEN d > {c!r} THEN {horner(rows[i, j])} ELSE 0.0 END)" for j in range(m)) +
        f"] AS phi FROM (SELECT *, (least(d, 1.0) - {c!r}) / {1.0 - c!r} AS s FROM kp WHERE is_fit_user) GROUP BY user_id, item_id"
        for i, c in enumerate(P.KDE_CUTOFFS))
    # held-out vectors of users without a reference vector have no pair
    held = ("SELECT h.user_id, h.item_id, 1.0 / (count(*) OVER (PARTITION BY h.user_id) * "
            "(SELECT count(DISTINCT user_id) FROM sp WHERE is_fit_user)::DOUBLE) AS w FROM sp h WHERE h.is_fit_user AND NOT h.is_ref")
    zeros = f"list_transform(range({m}), lambda x: 0.0)"
    feats = ("SELECT c.cutoff, h.w, coalesce(p.phi, " + zeros + ") AS phi FROM held h CROSS JOIN (SELECT unnest(["
             + ", ".join(repr(c) for c in P.KDE_CUTOFFS) + "]) AS cutoff) c LEFT JOIN phis p ON p.user_id = h.user_id "
             "AND p.item_id = h.item_id AND p.cutoff = c.cutoff")

    def step(prev):
        new = ", ".join(f"sum(CASE WHEN dens > 0 THEN w * pi[{j + 1}] * phi[{j + 1}] / dens END) / sum(CASE WHEN dens > 0 THEN w END)"
                        for j in range(m))
        return (f"SELECT cutoff, [{new}] AS pi, sum(-w * ln(greatest(dens, 1e-10))) AS objective FROM (SELECT f.cutoff, f.w, f.phi, p.pi, "
                f"list_dot_product(f.phi, p.pi) AS dens FROM feats f JOIN {prev} p ON p.cutoff = f.cutoff) GROUP BY cutoff")
    start = f"SELECT DISTINCT cutoff, list_transform(range({m}), lambda x: {1.0 / m!r}) AS pi FROM feats"
    out = " UNION ALL ".join(
        f"SELECT {k} AS step, cutoff, list_transform(pi, lambda x: round(x, {R6})) AS weights, round(objective, {R6}) AS objective FROM em{k}"
        for k in (1, 2))
    return _with(*ctes, ("phis", phi), ("held", held), ("feats", feats), ("em0", start), ("em1", step("em0")), ("em2", step("em1"))) + out


def source_sql() -> dict[str, str]:
    """Round trips through files must give back the relation that was written."""
    base = stats_sql()
    return {"read_ratings": base["ratings"], "read_items": base["items"],
            "read_item_vectors": base["item_vectors"]}


def _positive_zero(sql: str) -> str:
    """Rewrite every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB keeps the sign of a
    tiny negative value (``-0.0``) where Spark's decimal rounding gives ``0.0``; adding
    0.0 turns -0.0 into 0.0 and changes nothing else."""
    out, k = [], 0
    while True:
        j = sql.find("round(", k)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[k:])
                return "".join(out)
            out.append(sql[k:j + 6])
            k = j + 6
            continue
        depth, e = 0, j + 5
        while True:
            if sql[e] == "(":
                depth += 1
            elif sql[e] == ")":
                depth -= 1
                if depth == 0:
                    break
            e += 1
        out.append(sql[k:j])
        out.append("(round(" + _positive_zero(sql[j + 6:e]) + ") + 0.0)")
        k = e + 1


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(stats_sql())
    out.update(posterior_sql())
    out.update(vectors_sql())
    out.update(normalize_sql())
    out.update(study_sql())
    out.update(kernel_sql())
    out.update(source_sql())
    return {k: _positive_zero(v) for k, v in out.items()}
