"""What several corpus operators need: written intermediate tables, global order, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII upper case to lower case; other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only when its counted bytes stay below this.
BROADCAST_BYTES = 48_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    A new one is made only where none is set and all of Spark runs on this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return a reader of it.

    This cuts lineage as checkpoint() does, but compressed, and survives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, where its files give fewer (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its counted bytes (16 a value, and what strings and arrays hold) stay below the limit."""
    held = [F.octet_length(c) if k in ("string", "binary") else F.size(c) * 64 for c, k in df.dtypes if k in ("string", "binary") or k.startswith("array")]
    more = sum((F.coalesce(x, F.lit(0)) for x in held), F.lit(0))
    total = df.agg(F.sum(more + 16 * (len(df.columns) + 1)).alias("bytes")).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: Column, text: Column) -> Column:
    """Key of a row by content: equal rows share it, rows that only share an id don't."""
    return F.xxhash64(id_col, text)


def global_prefix(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Add `row_index` (0-based) and `before` (sum of `weight` ahead) in the global order of `order`.

    Range partitions are sorted apart; only one row per partition (count, total) meets in one
    place, so no task ever sees more than its own range. The table is written between, since
    two runs of a range exchange may cut differently. Ties beyond `order` fall in any order;
    a running number splits keys that hold many rows.
    """
    parts = materialize(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id()),
        name,
    )
    totals = parts.groupBy("_part").agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum0"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_row0"),
    )
    inside = Window.partitionBy("_part").orderBy(*[F.col(c) for c in order], "_tie")
    return (
        parts.withColumn("_n", F.row_number().over(inside))
        .withColumn("_s", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn("row_index", F.col("_row0") + F.col("_n") - 1)
        .withColumn("before", (F.col("_sum0") + F.col("_s") - F.col(weight)).cast("long"))
        .drop("_tie", "_part", "_n", "_s", "_sum0", "_row0")
    )
