import __spark_entry__ as E
from ratinglab.plans import queries as plans


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = set(plans.queries())  # the others are the optional pipeline operators
    assert own <= set(qs) and len(own & set(sql)) >= 47 and len(own - set(sql)) <= 3
