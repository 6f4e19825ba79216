import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from sample_texts import sample_docs  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from ratinglab.session import build_session
    return build_session(master="local[4]", shuffle_partitions=8)


@pytest.fixture(scope="session")
def docs(spark):
    """sample_docs with extra columns whose names operators also use inside."""
    rows = [(i, t, "en" if k % 3 else None, "s", k, float(k), "w") for k, (i, t) in enumerate(sample_docs())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double, word string")
