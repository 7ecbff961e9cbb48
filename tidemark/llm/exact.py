"""Exact dedup as a stream: keyed state on disk finds hits, full texts confirm them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import broadcast_if_small, lower_ascii, materialize, shared_dir

#: Files of a micro-batch at most.
FILES = 256
#: Hex digits of SHA-256 that key the state. Fewer make collisions, which the check of full texts then parts.
DIGITS = 64
#: The store of the keyed state: on local disk, its log in the checkpoint folder, bounded memory for all stores of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a small store reserves no disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}
ROW = "id bigint, sha string, file string, row bigint"
KEPT = f"{ROW}, level int, batch bigint"
SEEN = "sha string, level int, rep_id bigint, rep_file string, rep_row bigint, seen bigint, batch bigint"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a query started inside takes over; the session's own come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, file, row) to (id, SHA-256 of the text with A-Z lowered, file, row)."""
    for batch in batches:
        low = pc.ascii_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), "")).cast(pa.large_binary())
        sha = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in low], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), sha, batch.column(2), batch.column(3)], names=["id", "sha", "file", "row"])


def _run(stream: DataFrame, mode: str, to: str, checkpoint: str) -> None:
    """All that is there, each batch into a folder of its own, which a batch that is run again replaces."""
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{to}/batch={i}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def _ingest(spark: SparkSession, path: str, id_col: str, text_col: str, folder: str, files: int) -> None:
    """New source files as rows (id, sha, locator) of level 0. The locator is the text's file and its place in it."""
    one_file = path if path.endswith("/") else f"{path[:-1]}[{path[-1]}]"  # a file alone is no stream's folder; as a pattern it is
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(one_file)
    rows = source.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    _run(rows.mapInArrow(_hashed, ROW), "append", f"{folder}/rows/level=0", f"{folder}/ingest")


def _remember(spark: SparkSession, folder: str, digits: int) -> None:
    """Put new rows of any level into the keyed state and note each touched key.

    The state of a key (digest, level) is the id and locator of its first text and how many
    rows came; it never expires. Rows of a key are combined in their own tasks before the
    shuffle, so copies by the million are a few rows for the key's task.
    """
    new = spark.readStream.schema(KEPT).parquet(f"{folder}/rows")
    rep = F.first(F.struct("id", "file", "row")).alias("rep")
    keyed = new.groupBy(F.substring("sha", 1, digits).alias("sha"), "level").agg(rep, F.count(F.lit(1)).alias("seen"))
    with _settings(spark, STATE):
        _run(keyed.select("sha", "level", *[F.col(f"rep.{c}").alias(f"rep_{c}") for c in ("id", "file", "row")], "seen"), "update", f"{folder}/seen", f"{folder}/state")


def _differ(spark: SparkSession, path: str, text_col: str, folder: str, digits: int, level: int, new: DataFrame) -> DataFrame:
    """Those of the level's `new` rows whose text isn't that of their key's first row, full texts compared.

    Texts are read at their locators and meet by key; a key with very many rows is one side's
    skew, which Spark splits as the other side has one row a key.
    """
    notes = spark.read.schema(SEEN).parquet(f"{folder}/seen").filter(F.col("level") == level)
    keys = notes.groupBy("sha").agg(F.max_by(F.struct("rep_file", "rep_row"), "seen").alias("rep"), F.max("seen").alias("seen")).filter("seen > 1").select("sha", "rep.*")
    keys = materialize(keys, "exact-keys")  # as a table, so that Spark can split the other side's hot keys
    keyed = new.withColumnRenamed("sha", "_sha").withColumn("sha", F.substring("_sha", 1, digits))
    hits = keyed.join(keys, "sha").filter("file <> rep_file OR row <> rep_row").select("id", F.col("_sha").alias("sha"), "file", "row", "rep_file", "rep_row")
    text = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    here = text.join(broadcast_if_small(hits), ["file", "row"])
    reps = hits.select(F.col("rep_file").alias("file"), F.col("rep_row").alias("row")).distinct()
    first = text.join(broadcast_if_small(reps), ["file", "row"]).select(F.col("file").alias("rep_file"), F.col("row").alias("rep_row"), F.col("text").alias("rep_text"))
    equal = F.when(F.col("text") == F.col("rep_text"), True).otherwise(lower_ascii(F.col("text")) == lower_ascii(F.col("rep_text")))
    return here.join(first, ["rep_file", "rep_row"]).filter(~equal).select("id", "sha", "file", "row")


def dedupe_stream(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, files: int = FILES, digits: int = DIGITS,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row in the Parquet files at `path`.

    Three steps, each of which a later run with the same shared `folder` takes up where it
    stopped: a stream writes digest, id and locator of every row; a second stream keeps one
    state per digest on disk; hits among the new rows are settled by their full texts. A row
    that only shares a digest goes to the next level, where it has a state apart, until none
    does. Groups are read from the levels, so an earlier run's rows are regrouped, not redone.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group
    the row with the largest id stays (null ids are smallest; of repeated rows one stays).
    Empty table: no rows. Other columns are ignored.
    """
    folder = folder or f"{shared_dir(spark)}/tidemark-exact-{uuid.uuid4().hex}"
    nothing = lambda schema, to: spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{to}")
    nothing(ROW, "rows/level=0/batch=-1")
    nothing("upto bigint", "checked/level=-1")
    _ingest(spark, path, id_col, text_col, folder, files)
    level = 0
    while True:
        _remember(spark, folder, digits)
        rows = spark.read.schema(KEPT).parquet(f"{folder}/rows").filter(F.col("level") == level)
        done = spark.read.schema("upto bigint, level int").parquet(f"{folder}/checked").filter(F.col("level") == level).agg(F.max("upto")).first()[0]
        upto = rows.agg(F.max("batch")).first()[0]
        if upto is not None and (done is None or upto > done):
            odd = _differ(spark, path, text_col, folder, digits, level, rows if done is None else rows.filter(F.col("batch") > done))
            odd.write.mode("overwrite").parquet(f"{folder}/rows/level={level + 1}/batch={upto}")
            spark.createDataFrame([(upto,)], "upto bigint").write.mode("overwrite").parquet(f"{folder}/checked/level={level}")
        if spark.read.schema(KEPT).parquet(f"{folder}/rows").filter(F.col("level") > level).isEmpty():
            break
        level += 1
    rows = spark.read.schema(KEPT).parquet(f"{folder}/rows")
    if level:  # a row counts at its last level
        rows = rows.groupBy("file", "row").agg(F.max(F.struct("level", "sha", "id")).alias("x")).select("file", "row", "x.*")
    groups = rows.groupBy("sha", "level").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "file", "row")).alias("top"))
    groups = materialize(groups, "exact-groups")
    kept = (F.col("file") == F.col("top.file")) & (F.col("row") == F.col("top.row"))
    return rows.join(groups, ["sha", "level"]).select(F.col("id").alias("doc_id"), F.col("top.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_stream(spark, f"{sf_dir}/documents.parquet")


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM d WINDOW w AS (PARTITION BY t))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM s
"""
