"""Ratings as a frame, for tests of the rating operators."""

SF001 = "/root/testdata/sf0.001"


def ratings_df(spark, rows):
    """rows: (user_id, item_id, rating)"""
    return spark.createDataFrame(rows, "user_id int, item_id int, rating double")
