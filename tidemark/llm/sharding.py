"""Balanced shards from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import global_prefix


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every document to one of `n_shards` contiguous shards of near equal bytes.

    Documents are ordered by (id, size, crc32); per-partition totals give each row the bytes
    ahead of it, and the row's midpoint picks the shard: floor(midpoint * n / total). A shard
    is therefore off its target by at most one document. Result: id, size, text_crc32, law,
    shard, slot, grown_shard (null: only a `key` law has one).

    Null text: size 1, crc32 0. Null ids come first. Repeated rows are each placed. Empty
    table: no rows. Other columns of `docs` are ignored. One document above the target fills
    a shard alone, and shards it spans stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = global_prefix(slim, ["doc_id", "size", "text_crc32"], "size", "shard")
    total = placed.agg(F.sum("size").alias("_total"))  # one row
    cut = placed.join(F.broadcast(total)).withColumn(
        "shard",
        F.least(F.lit(n_shards - 1), F.expr(f"((2 * before + size) * {n_shards}) div (2 * _total)")).cast("int"),
    )
    first = cut.groupBy("shard").agg(F.min("row_index").alias("_first"))  # n_shards rows at most
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row_index") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 (reflected polynomial 0xEDB88320) as a fold over the text's bytes, once per distinct text.
OP3_SQL = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, strlen(text) + 1), lambda k: ('0x' || substr(h, (2 * k - 1)::INT, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT text, hex(encode(text)) AS h FROM texts), tab),
d AS (
  SELECT doc_id, strlen(coalesce(d.text, ''))::BIGINT + 1 AS size, crc AS text_crc32
  FROM documents d JOIN crcs c ON coalesce(d.text, '') = c.text),
p AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS r,
         sum(size) OVER () AS total FROM d),
s AS (SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
