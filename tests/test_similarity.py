import numpy as np
import pytest

from rating_rows import SF001
from ratinglab.operators import similarity
from ratinglab.sources import fixtures as fx


def test_exact_pairs_and_lsh_recall(spark):
    iv = fx.item_vectors(spark, SF001, 6).cache()
    unit = similarity.normalized_vectors(iv).cache()
    exact = similarity.similar_items_exact(unit, unit, 0.4).toPandas()
    u = unit.toPandas()
    m = np.stack(u["unit_vector"].to_numpy())
    d = m @ m.T
    assert len(exact) == int((d > 0.4).sum())
    lsh = similarity.similar_items_lsh(unit, unit, unit, 0.4).toPandas()
    e = set(zip(exact.left_id, exact.right_id))
    l_ = set(zip(lsh.left_id, lsh.right_id))
    assert l_ <= e
    assert len(l_) / len(e) >= 0.95


def test_zero_vectors_are_dropped_and_counted(spark):
    iv = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "item_id int, item_vector array<double>")
    assert [r["item_id"] for r in similarity.normalized_vectors(iv).collect()] == [2]
    assert similarity.zero_vector_count(iv).first()["n_zero"] == 1


def test_key_join_is_selective_and_sound(spark):
    from ratinglab.plans import params as P
    from ratinglab.plans.queries import _vec_inputs
    _, iv = _vec_inputs(spark, "/root/testdata/sf0.001", None)
    unit = similarity.normalized_vectors(iv)
    exact = {(r.left_id, r.right_id) for r in similarity.similar_items_exact(unit, unit, P.CUTOFF).collect()}
    got = {(r.left_id, r.right_id) for r in similarity.similar_items_keys(unit, unit, P.CUTOFF, 64, P.LSH_TABLES, P.LSH_WIDTH).collect()}
    assert got <= exact and len(got) >= 0.5 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_key_join_recall_without_self_pairs(spark, sf):
    from ratinglab.plans import params as P
    from ratinglab.plans.queries import _vec_inputs
    _, iv = _vec_inputs(spark, f"/root/testdata/{sf}", None)
    unit = similarity.normalized_vectors(iv).cache()
    keys = similarity.similar_items_keys(unit, unit, P.CUTOFF, fx.EMBEDDING_DIM, P.LSH_TABLES, P.LSH_WIDTH)
    exact, got = ({(r.left_id, r.right_id) for r in df.where("left_id <> right_id").collect()}
                  for df in (similarity.similar_items_exact(unit, unit, P.CUTOFF), keys))
    print(sf, len(got), "of", len(exact))
    assert len(exact) > 100 and got <= exact and len(got) >= 0.95 * len(exact)


@pytest.mark.parametrize("dim", [3, 24])
def test_block_join_equals_brute_force(spark, monkeypatch, dim):
    """Small blocks; the self-join tests each pair once and skips full dots, and gives both directions."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(8, dim)) * np.linspace(3.0, 0.1, dim)  # energy falls with the component
    v = centres[rng.integers(0, 8, 240)] + rng.normal(size=(240, dim)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id int, unit_vector array<double>")
    monkeypatch.setattr(similarity, "ROWS", 50)
    monkeypatch.setattr(similarity, "TILE", 300)
    d = v @ v.T
    want = {(i, j) for i, j in zip(*np.nonzero(d > 0.8))}
    for got in (similarity.similar_items_exact(df, None, 0.8).collect(), similarity.similar_items_exact(df, df, 0.8).collect()):
        assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want
        assert all(abs(r.dot - d[r.left_id, r.right_id]) < 1e-12 for r in got)
    part = similarity.similar_items_exact(df.where("item_id < 40"), df, 0.8).collect()
    assert {(r.left_id, r.right_id) for r in part} == {p for p in want if p[0] < 40}
    work = similarity.similarity_work(df, None, 0.8).first()
    assert work.n_pairs == 240 * 241 // 2 and len(want) // 2 <= work.n_full < work.n_pairs // 2


def test_block_join_of_empty_sides(spark):
    none = spark.createDataFrame([], "item_id int, unit_vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], none.schema)
    assert similarity.similar_items_exact(none).collect() == []
    assert similarity.similar_items_exact(one, none).collect() == [] == similarity.similar_items_exact(none, one).collect()
    assert [(r.left_id, r.right_id) for r in similarity.similar_items_exact(one).collect()] == [(1, 1)]


def test_dense_tiles_give_the_same_pairs(spark, monkeypatch):
    """Where the bound rules out little, dots come from one more matrix product; never, always and mixed agree."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id int, unit_vector array<double>")
    d = v @ v.T
    want = {(i, j) for i, j in zip(*np.nonzero(d > 0.4))}
    for dense in (0, 32, 1 << 30):
        monkeypatch.setattr(similarity, "DENSE", dense)
        got = similarity.similar_items_exact(df, None, 0.4).collect()
        assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
        assert all(abs(r.dot - d[r.left_id, r.right_id]) < 1e-12 for r in got)


def test_key_join_tests_buckets_as_blocks(spark, monkeypatch):
    """No row for a candidate pair, and large buckets in slices: the same pairs as equal keys and an exact filter."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4, 8))[rng.integers(0, 4, 200)] + rng.normal(size=(200, 8)) * 0.4
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id int, unit_vector array<double>")
    d = v @ v.T
    same = np.zeros(d.shape, bool)
    for table in similarity.lsh_draws(8, 3):
        key = np.stack([np.floor(v @ np.array(signs) / 2.5 + shift) for signs, shift in table], axis=1)
        same |= (key[:, None] == key[None]).all(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(same & (d > 0.4)))}
    for rows in (1 << 15, 7):
        monkeypatch.setattr(similarity, "BUCKET_ROWS", rows)
        monkeypatch.setattr(similarity, "ROWS", rows)
        for right in (df, df.select("*")):
            pairs = similarity.similar_items_keys(df, right, 0.4, 8, 3, 2.5)
            got = pairs.collect()
            assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
    part = similarity.similar_items_keys(df.where("item_id < 30"), df, 0.4, 8, 3, 2.5).collect()
    assert {(r.left_id, r.right_id) for r in part} == {p for p in want if p[0] < 30}
