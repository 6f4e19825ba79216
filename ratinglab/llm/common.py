"""Shared helpers: table reading, written intermediate tables, word pattern, broadcast bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratinglab.session import scratch_path

#: ASCII white space, the only separators of words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Largest object any operator broadcasts; larger inputs are read in blocks or joined.
BROADCAST_LIMIT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost
    executors, and later readers fetch only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+`` (null text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns: extra columns of the input, whatever they are called, go."""
    return df.select(*[c.alias(n) for n, c in columns.items()])
