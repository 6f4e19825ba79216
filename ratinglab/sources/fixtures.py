"""Relations the engine works on, derived by Spark from the driver's tables.

* ``ratings(user_id int, item_id int, rating double, ts timestamp)``:
  ``lineitem`` joined with ``orders`` on the order key, one row per (customer, part):
  ``rating = 0.5 * ceil(max(l_quantity) / 5)``, ``ts = max(o_orderdate)``.
* ``items(item_id int, title string)``: the whole ``part`` table.
* ``item_vectors(item_id int, item_vector array<double>, mean double, std double)``:
  ``embeddings`` on ``vec_id = item_id``, first ``rank`` components (the model rank),
  mean and population std of the item's ratings, items with std 0 dropped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Most rows of a task that groups pairs, and fewest that are worth one.
TASK_ROWS, SMALL = 400_000, 20_000


def pair_tasks(n: int, partitions: int) -> int:
    """Tasks for n rows: as many as ``partitions`` while these are not small, more where they would be large."""
    return max(1, -(-n // TASK_ROWS), min(partitions, -(-n // SMALL)))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # nearly every pair occurs once, so pairs meet before they are grouped: adding up in every task first would
    # hold a table of all its rows, and a task's share would grow with the input
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = pair_tasks(li.count(), partitions)
    if tasks > partitions:  # the join's sorts would grow likewise
        li, od = li.repartition(tasks, "l_orderkey"), od.repartition(tasks, "o_orderkey")
    per_pair = (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .repartition(tasks, "o_custkey", "l_partkey")
        .groupBy("o_custkey", "l_partkey")
        .agg(F.max("l_quantity").alias("q"), F.max("o_orderdate").alias("ts"))
    )
    return per_pair.select(
        F.col("o_custkey").cast("int").alias("user_id"),   # ANSI cast: overflow fails loudly
        F.col("l_partkey").cast("int").alias("item_id"),
        (F.ceil(F.col("q") / F.lit(5.0)).cast("double") * F.lit(0.5)).alias("rating"),
        F.col("ts"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("item_id"), F.col("p_name").alias("title"))


EMBEDDING_DIM = 64


def _projected(component: str, zero_based: bool, j: int) -> str:
    """Component j of the projection: a signed sum of every embedding component, with signs from
    a hash. The same text, term by term, for Spark (0-based) and DuckDB (1-based)."""
    terms = []
    for i in range(EMBEDDING_DIM):
        sign = "-" if hashlib.md5(f"projection|{i}|{j}".encode()).digest()[0] & 1 else "+"
        terms.append(f"{sign} CAST({component}[{i if zero_based else i + 1}] AS DOUBLE)")
    return f"(({' '.join(terms).removeprefix('+ ')}) * CAST(0.125 AS DOUBLE))"


def item_vectors(spark: SparkSession, sf_dir: str, rank: int | None = None, ratings_df: DataFrame | None = None) -> DataFrame:
    """Whole embeddings, or with ``rank`` a fixed projection of all components to that many."""
    r = ratings_df if ratings_df is not None else ratings(spark, sf_dir)
    stats = (r.groupBy("item_id")
             .agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"))
             .where(F.col("std") > 0))
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("item_id"),
        (F.col("embedding").cast("array<double>") if rank is None else
         F.array(*[F.expr(_projected("embedding", True, j)) for j in range(rank)])).alias("item_vector"))
    return emb.join(stats, "item_id").select("item_id", "item_vector", "mean", "std")


def sql_ratings() -> str:
    """The same ratings relation in DuckDB SQL (a CTE body)."""
    return (
        "SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS item_id, "
        "0.5 * CAST(ceil(max(l_quantity) / 5.0) AS DOUBLE) AS rating, max(o_orderdate) AS ts "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey"
    )


def sql_items() -> str:
    return "SELECT CAST(p_partkey AS INTEGER) AS item_id, p_name AS title FROM part"


def sql_item_vectors(rank: int | None = None) -> str:
    """Needs a ``ratings`` CTE in scope."""
    vector = "CAST(e.embedding AS DOUBLE[])" if rank is None else \
        "[" + ", ".join(_projected("e.embedding", False, j) for j in range(rank)) + "]"
    return (
        f"SELECT CAST(e.vec_id AS INTEGER) AS item_id, {vector} AS item_vector, "
        "s.mean, s.std FROM embeddings e JOIN ("
        "SELECT item_id, avg(rating) AS mean, stddev_pop(rating) AS std FROM ratings GROUP BY item_id"
        ") s ON s.item_id = CAST(e.vec_id AS INTEGER) WHERE s.std > 0"
    )
