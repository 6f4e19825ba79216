"""The file-based jobs and the vector-set path."""

import numpy as np
import pytest

from ratinglab.operators import kernel
from ratinglab.plans import jobs
from ratinglab.session import checkpoint_root
from ratinglab.sources import fixtures as fx
from ratinglab.sources import io

SF = "/root/testdata/sf0.001"


def test_kernel_fit_job_does_not_depend_on_splits(spark, tmp_path):
    r = fx.ratings(spark, SF)
    sets = kernel.vector_sets(r, fx.item_vectors(spark, SF, 6, r), 40)
    io.write_vector_sets(sets, str(tmp_path / "sets"))
    first = [x.line for x in spark.read.text(str(tmp_path / "sets")).toDF("line").limit(2).collect()]
    assert first[0] == "***"
    raw = {tuple(round(float(v), 6) for v in x.item_vector) for x in sets.select("item_vector").collect()}
    assert tuple(round(float(v), 6) for v in first[1].split(" ")) in raw  # raw vectors, not unit ones
    got = {}
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            back = io.read_vector_sets(spark, str(tmp_path / "sets"))
            parts = back.rdd.getNumPartitions()
            ids = sorted(x.set_id for x in back.select("set_id").distinct().collect())
            sweep = jobs.kernel_fit_job(spark, str(tmp_path / "sets"), str(tmp_path / f"kernel{size}"), 6, cutoffs=(0.2,), m=4)
            got[size] = parts, ids, [x.coeffs for x in sweep.select("coeffs").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got["2k"][1]) == 40 and got["2k"][1] == got["128m"][1]
    np.testing.assert_allclose(got["2k"][2], got["128m"][2], rtol=1e-6)


def test_kde_values_without_cap(spark):
    rows = [(1, 1, [1.0, 0.0], True, True), (1, 2, [2.0, 0.0], True, False)]
    split = spark.createDataFrame(rows, "user_id int, item_id int, unit_vector array<double>, is_fit_user boolean, is_ref boolean")
    value = lambda cap: kernel.kde_values(split, [[0.0, 1.0]], [0.0], cap=cap).first().value
    assert value(True) == 1.0 and value(False) == 2.0


def test_write_study_files(spark, tmp_path):
    r = fx.ratings(spark, SF)
    io.write_ratings(r, str(tmp_path / "ratings"))
    jobs.sampling_study_job(spark, str(tmp_path / "ratings"), str(tmp_path / "out"), trusted_min=5, sizes=(5, 10))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["avg_iterations.txt"] + sorted(f"{n}.txt" for n in io.STUDY_FILES.values())
    lines = [x.value for x in spark.read.text(str(tmp_path / "out" / "avg_iterations.txt")).collect()]
    assert [x.split("\t")[0] for x in lines] == ["5", "10"]


def test_checkpoint_folder_is_required_off_local():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None
    session = type("Session", (), {"sparkContext": Context(), "conf": Context()})()
    with pytest.raises(ValueError):
        checkpoint_root(session)
