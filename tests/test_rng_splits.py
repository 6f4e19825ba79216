import duckdb
from pyspark.sql import functions as F

from ratinglab.functions.rng import hash_normal, hash_uniform, sql_hash_uniform
from ratinglab.operators import splits


def test_hash_uniform_matches_duckdb(spark):
    df = spark.createDataFrame([(7, 9)], "a int, b int")
    v = df.select(hash_uniform(42, "split", "a", "b").alias("u")).first()["u"]
    d = duckdb.sql(f"SELECT {sql_hash_uniform(42, 'split', '7', '9')} AS u").fetchall()[0][0]
    assert v == d == 0.25497124553730866


def test_uniform_range_and_normal_moments(spark):
    df = spark.range(20000).select(hash_uniform(1, "t", "id").alias("u"), hash_normal(1, "n", "id").alias("z"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 < r[0] and r[1] < 1
    assert abs(r[2]) < 0.03 and abs(r[3] - 1) < 0.03


def test_hash_split_is_partition_invariant(spark):
    df = spark.range(5000).select(F.col("id").cast("int").alias("user_id"), (F.col("id") % 7).cast("int").alias("item_id"))
    a = splits.hash_split(df.repartition(1), 0.8, 3).where("is_train").count()
    b = splits.hash_split(df.repartition(17), 0.8, 3).where("is_train").count()
    assert a == b and 3800 < a < 4200
