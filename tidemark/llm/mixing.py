"""Mix sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import broadcast_if_small, global_prefix, materialize, n_words

#: Weights of the sources in code point order, repeating; no document is taken more often than CAP.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target, rate = target / size, from rows (source, size).

    Targets share the sum of all sizes by weight; a target stops at `cap` times its source's
    size and the excess is shared again among the others by weight until none is above. In the
    order of size / weight, sources stop one after the other: with all sources ahead of one
    stopped, the level (words for a unit of weight) is what they leave over the weights from it
    on, and the first source that this level doesn't stop sets it. One pass of prefix sums over
    the small table of sources. A source without words has target and rate 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = global_prefix(
        sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "source_size", "sources"
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("row_index") % len(weights) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.cast("long").alias("w"))
    full = lambda c: F.col("source_size") * cap / F.col(c)
    by_size = global_prefix(weighed.withColumn("_at", full("w")), ["_at", "source"], "source_size", "weights").drop("row_index").withColumnRenamed("before", "_size_before")
    table = materialize(global_prefix(by_size, ["_at", "source"], "w", "levels").withColumnRenamed("before", "_w_before"), "levels")
    total, all_w = table.agg(F.sum("source_size"), F.sum("w")).first()
    level = 0.0
    if total:
        at = (F.lit(float(total)) - F.col("_size_before") * cap) / (F.lit(all_w) - F.col("_w_before"))
        # without a source that isn't stopped, all stop: the sum of the caps is below the total
        level = table.filter(at <= F.col("_at")).agg(F.max(at)).first()[0]
        level = float("inf") if level is None else level
    limit = F.col("source_size") * cap
    target = F.when(F.col("w") * F.lit(level) > limit, limit.cast("double")).otherwise(F.col("w") * F.lit(level))
    return table.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    )


def coin(id_text, text_md5, seed: str = SEED):
    """Number in [0, 1) from md5 of seed, id and the text's md5: the same in every run."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(id_text, F.lit("")), text_md5)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def take_plan(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (and the columns in `keep`).

    copies = floor(rate) plus one more where the document's coin is below the fraction of rate.
    Null text: size 0. Null source: a source of its own, last. Repeated rows share one coin.
    Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        coin(F.col(id_col).cast("string"), F.md5(text.cast("binary"))).alias("_coin"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    if not keep:  # without the texts the rows are small: read the texts once
        sized = materialize(sized, "sized")
    rates = broadcast_if_small(source_rates(sized.select("source", "size")))
    out = sized.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    copies = F.floor("rate") + (F.col("_coin") < F.col("rate") - F.floor("rate")).cast("long")
    return out.select("d.doc_id", "d.source", "size", "source_size", "target", copies.cast("long").alias("copies"), *[f"_keep_{c}" for c in keep])


def mix_sources(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with the columns of `docs`.

    Null sources are one source, the last. Null and empty texts have size 0 and are repeated
    like others of their source; a source without words is left out (rate 0). Repeated rows are
    copied alike. Empty table: no rows.
    """
    plan = take_plan(docs, keep=tuple(docs.columns))
    many = plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return many.select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return take_plan(docs).select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT
           / 281474976710656.0::DOUBLE AS coin FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS full_before,
         sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         sum(source_size) OVER () AS total
  FROM r WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(max((total - full_before)::DOUBLE / rest_w), 0) AS v FROM o
  WHERE (total - full_before)::DOUBLE / rest_w <= 3.0::DOUBLE * source_size / w),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, w * v) AS target FROM r, level),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""
