"""Blocks of a two-dimensional grid.

Some operators of the reference are dense products of two sets (histograms x priors,
users x items). Written as joins they would be Cartesian products. Here both sides get a
block number by a hash of their key, each block is copied to the blocks of the other side,
and one cogrouped Arrow step per (block, block) multiplies the two as matrices, emitting only
partial sums or a partial top-N, which ordinary ``groupBy``/window operators finish. A task
holds one block of each side whatever the data size, and nothing passes through the driver
but row counts.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratinglab.session import scratch_path

def row_block(n_other: int, target_cells: int = 1 << 22) -> int:
    """Rows per block so that a block times ``n_other`` stays near ``target_cells``."""
    return max(1, target_cells // max(1, n_other))


def written(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, kept when executors go. ``free``: the
    shuffles that made it are not read again, and their files go now, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    if free:  # Spark removes a shuffle's files when nothing refers to it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Most partitions that one grid is dealt to; further cells share them.
MAX_PARTITIONS = 20_000


def block_count(spark: SparkSession, n: int, size: int, least: int, others: int = 1) -> int:
    """Blocks of about ``size`` rows; smaller ones, of ``least`` rows or more, while the tasks of
    a shuffle outnumber the cells with ``others`` blocks of the other side. Only the cut depends on
    it, never a result."""
    tasks = -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // others)
    return max(1, -(-n // size), min(tasks, -(-n // least)))


def grid(left: DataFrame, right: DataFrame, left_block: Column, right_block: Column, n_left: int, n_right: int,
         cell: Callable, schema, only: str = "true") -> DataFrame:
    """``cell(left rows, right rows)`` on Arrow tables for every pair of blocks where ``only`` holds. The
    columns ``lb`` and ``rb`` hold the block numbers on both sides."""
    n = min(n_left * n_right, MAX_PARTITIONS)

    def every(k):
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select("*", left_block.cast("int").alias("lb"), every(n_right).alias("rb")).where(only).repartition(n, "lb", "rb")
    b = right.select("*", right_block.cast("int").alias("rb"), every(n_left).alias("lb")).where(only).repartition(n, "lb", "rb")
    return a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb")).applyInArrow(cell, schema)


def streamed_grid(left: DataFrame, right: DataFrame, left_block: Column, right_block: Column, n_left: int, n_right: int,
                  cell: Callable, schema) -> DataFrame:
    """``grid`` for cells with an answer for most pairs: ``cell(left rows, right rows)`` yields Arrow record batches, of
    which a task holds one at a time. So blocks can be as large as where a cell sums up, and few copies are sent."""
    n = min(n_left * n_right, MAX_PARTITIONS)

    def every(k):
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select(F.struct(*left.columns).alias("left"), left_block.cast("int").alias("lb"), every(n_right).alias("rb"))
    b = right.select(F.struct(*right.columns).alias("right"), right_block.cast("int").alias("rb"), every(n_left).alias("lb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        sides = [rows.column(c).filter(rows.column(c).is_valid()) for c in ("left", "right")]
        del rows
        if all(len(x) for x in sides):
            yield from cell(*(pa.Table.from_struct_array(x.combine_chunks()) for x in sides))
    both = a.unionByName(b, allowMissingColumns=True).repartition(n, "lb", "rb")
    return both.groupBy("lb", "rb").applyInArrow(run, schema)


def hashed(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n))
