"""Sources and sinks.

Readers take explicit schemas (no inference pass over the data). Writers are
distributed: nothing is gathered on the driver; where line order matters the rows are
range-partitioned and sorted within partitions, so part files concatenate in order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratinglab.functions.vectors import l2_normalize
from ratinglab.session import ship_package

# Input CSV layouts (ratings: userId,movieId,rating,timestamp; items: movieId,title,genres).
RATINGS_CSV = T.StructType([T.StructField("userId", T.IntegerType()), T.StructField("movieId", T.IntegerType()),
                            T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
ITEMS_CSV = T.StructType([T.StructField("movieId", T.IntegerType()), T.StructField("title", T.StringType()),
                          T.StructField("genres", T.StringType())])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``userId,movieId,rating,timestamp`` CSV with header -> ``user_id, item_id, rating, ts``."""
    df = spark.read.schema(RATINGS_CSV).option("header", True).csv(path)
    return df.select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating",
                     F.timestamp_seconds("timestamp").alias("ts"))


def write_ratings(ratings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Inverse of S1 (used for round trips)."""
    (ratings.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating",
                    F.unix_timestamp("ts").alias("timestamp"))
     .write.mode(mode).option("header", True).csv(path))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``movieId,title,genres`` CSV -> ``item_id, title`` (genres dropped)."""
    df = spark.read.schema(ITEMS_CSV).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df.select(F.col("movieId").alias("item_id"), "title")


def write_items(items: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (items.select(F.col("item_id").alias("movieId"), "title", F.lit("(no genres listed)").alias("genres"))
     .write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path))


def read_item_vectors(spark: SparkSession, path: str) -> DataFrame:
    """S3: the model table. Accepts the reference's column names (``movieId``,
    ``movieVector``) or ours; vectors come back as ``array<double>``."""
    df = spark.read.parquet(path)
    if "movieId" in df.columns:
        df = df.withColumnRenamed("movieId", "item_id").withColumnRenamed("movieVector", "item_vector")
    return df.select(F.col("item_id").cast("int"), F.col("item_vector").cast("array<double>"), "mean", "std")


def write_item_vectors(item_vectors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``item_id int, item_vector array<float>, mean, std`` as Parquet; by default
    fails when the path exists, like the reference's default save mode."""
    (item_vectors.select(F.col("item_id").cast("int"), F.col("item_vector").cast("array<float>"), "mean", "std")
     .write.mode(mode).parquet(path))


def write_losses(runs: DataFrame, path: str, value_col: str = "mse", mode: str = "errorifexists") -> None:
    """One loss per line, in run order."""
    (runs.select("run", F.col(value_col).cast("string").alias("value")).repartitionByRange("run")
     .sortWithinPartitions("run").select("value").write.mode(mode).text(path))


# The five study output names, as the reference writes them.
STUDY_FILES = {
    ("mean", "sample"): "sample_mean_mse_mean",
    ("mean", "posterior"): "rejection_sampling_mse_mean",
    ("std", "sample"): "sample_mean_mse_std",
    ("std", "posterior"): "rejection_sampling_mse_std",
}


def write_study(mse: DataFrame, iterations: DataFrame, directory: str, mode: str = "errorifexists") -> None:
    """Five ``n<TAB>value`` outputs; the proposals file carries the rounded mean."""
    for (stat, est), name in STUDY_FILES.items():
        (mse.where((F.col("statistic") == stat) & (F.col("estimator") == est)).select("n", "mse")
         .repartitionByRange("n").sortWithinPartitions("n")
         .write.mode(mode).option("sep", "\t").csv(f"{directory}/{name}.txt"))
    (iterations.select("n", "avg_proposals_rounded").repartitionByRange("n").sortWithinPartitions("n")
     .write.mode(mode).option("sep", "\t").csv(f"{directory}/avg_iterations.txt"))


def write_vector_sets(sets: DataFrame, path: str, vector_col: str = "item_vector",
                      mode: str = "errorifexists") -> None:
    """For each user a ``***`` line, then one space-separated raw vector per line.

    Header and vector lines are rows keyed ``(user_id, pos)`` (header pos 0); rows are
    range-partitioned by user and sorted, so no user's block is assembled in memory."""
    lines = sets.select("user_id", "pos", F.concat_ws(" ", F.transform(vector_col, lambda x: x.cast("string")))
                        .alias("line"))
    headers = sets.select("user_id").distinct().select("user_id", F.lit(0).alias("pos"), F.lit("***").alias("line"))
    (headers.unionByName(lines).repartitionByRange("user_id").sortWithinPartitions("user_id", "pos")
     .select("line").write.mode(mode).text(path))


MARKER = "***"
_LINES = "file string, block bigint, at bigint, sets bigint, pos bigint, line string"


def _numbered(batches):
    """Lines with their place in the split, the markers up to them in it, and the vectors since the
    last of those (or since the split's start). A task reads splits one after the other."""
    key, at, sets, pos = None, 0, 0, 0
    for b in batches:
        out = []
        for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
            if (file, block) != key:
                key, at, sets, pos = (file, block), 0, 0, 0
            at += 1
            if line == MARKER:
                sets, pos = sets + 1, 0
            elif line.strip():
                pos += 1
                out.append((file, block, at, sets, pos, line))
                continue
            out.append((file, block, at, sets, pos, None))
        yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(
            ("file", "block", "at", "sets", "pos", "line"), zip(*out) if out else [[]] * 6)},
            schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("sets", pa.int64()),
                              ("pos", pa.int64()), ("line", pa.string())]))


def read_vector_sets(spark: SparkSession, path: str) -> DataFrame:
    """``set_id, pos, unit_vector``; every vector is L2-normalised while reading.

    Files are read by lines, in splits of any size: a set may begin in one split and go on in the next
    ones, and no set is ever one record. Each split counts its own markers and vectors; sums over the
    splits before it (one row for a split) give a set's number, counted over the files in the order of
    their paths, and a vector's place in its set. So ids follow the files, not the cut."""
    ship_package(spark)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_block_start").alias("block"), "value")
    lines = raw.mapInArrow(_numbered, _LINES)
    # the last line of a split has its totals
    ends = lines.groupBy("file", "block").agg(F.max(F.struct("at", "sets", "pos")).alias("last")).select("file", "block", "last.sets", "last.pos")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # in a run of splits without a marker, vectors add up from the one that opened the run
    ends = ends.withColumn("sets_before", F.coalesce(F.sum("sets").over(before), F.lit(0)))
    ends = ends.withColumn("run", F.col("sets_before") + F.col("sets"))
    within = Window.partitionBy("run").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("open", F.sum("pos").over(within))
    ends = ends.withColumn("pos_before", F.coalesce(F.lag("open").over(Window.orderBy("file", "block")), F.lit(0)))
    carried = ends.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "sets_before", "pos_before")
    rows = lines.where("line IS NOT NULL").join(carried, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    pos = F.col("pos") + F.when(F.col("sets") == 0, F.col("pos_before")).otherwise(0)
    vec = F.transform(F.split(F.trim("line"), " +"), lambda x: x.cast("double"))
    return rows.select((F.col("sets_before") + F.col("sets")).alias("set_id"), pos.cast("int").alias("pos"), l2_normalize(vec).alias("unit_vector"))


def write_kernel(sweep: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``cutoff<TAB>c0 c1 ...`` (monomial coefficients, low order first), accepted rows."""
    line = F.concat_ws("\t", F.col("cutoff").cast("string"),
                       F.concat_ws(" ", F.transform("coeffs", lambda x: x.cast("string"))))
    (sweep.where(F.col("accepted")).repartitionByRange("cutoff").sortWithinPartitions("cutoff")
     .select(line.alias("value")).write.mode(mode).text(path))


def read_kernel(spark: SparkSession, path: str) -> DataFrame:
    """``cutoff, coeffs array<double>`` from an S9 file."""
    raw = spark.read.text(path).where(F.length("value") > 0)
    parts = F.split("value", "\t")
    return raw.select(parts[0].cast("double").alias("cutoff"),
                      F.transform(F.split(parts[1], " "), lambda x: x.cast("double")).alias("coeffs"))
