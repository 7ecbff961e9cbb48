"""Time blocks: one entity's rows in pieces that are tasks of their own, with halo rows around them.

A job over a sequence runs in three steps: a block gives a summary, the summaries of an
entity are composed in block order, and each block runs again with what came before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.windows import Ent
from tidemark.sources.staging import stage

#: Rows of a block.
BLOCK_ROWS = 50_000


def positions(df: DataFrame, ent: Ent, t: str) -> DataFrame:
    """`df` with `_pos`, each row's place in its entity from 0, without a task that holds an entity.

    Rows are written in ranges of (ent, t). Each range numbers its own rows; entities that lie
    in several ranges (two per range at most) add what the ranges before hold.
    """
    parts = stage(df.repartitionByRange(*[F.col(c) for c in (*ent, t)]).withColumn("_part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("_part", *ent).agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy(*ent).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.withColumns({"_rows_ahead": F.sum("_rows").over(ahead), "_n": F.count(F.lit(1)).over(Window.partitionBy(*ent))}).filter("_n > 1")
    spans = spans.select(F.col("_part").alias("_in_part"), "_rows_ahead", *[F.col(c).alias(f"_e{i}") for i, c in enumerate(ent)])
    same = F.col("_part") == F.col("_in_part")
    for i, c in enumerate(ent):
        same &= F.col(c).eqNullSafe(F.col(f"_e{i}"))
    inside = Window.partitionBy("_part", *ent).orderBy(t)
    placed = parts.join(F.broadcast(spans), same, "left").withColumn("_pos", (F.row_number().over(inside) - 1 + F.coalesce("_rows_ahead", F.lit(0))).cast("long"))
    return placed.select(*df.columns, "_pos")


def blocks(df: DataFrame, ent: Ent, t: str, rows: int = BLOCK_ROWS, before: int = 0) -> DataFrame:
    """`df` with `_pos`, `_block` and `_own`: blocks of `rows` rows, each led by copies of the `before` rows ahead of it."""
    return halo(positions(df, ent, t), rows, before)


def halo(placed: DataFrame, rows: int, before: int) -> DataFrame:
    own = F.floor(F.col("_pos") / rows)
    if not before:
        return placed.withColumns({"_block": own, "_own": F.lit(True)})
    copied = placed.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("_pos") + before) / rows))))
    return copied.withColumn("_own", F.col("_block") == own)


def several(placed: DataFrame, rows: int) -> bool:
    """Whether any entity has more than one block."""
    return not placed.filter(F.col("_pos") >= rows).isEmpty()


def numbers(table: pa.Table, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns as doubles; nulls are NaN."""
    return {c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}


def with_columns(table: pa.Table, made: dict[str, np.ndarray]) -> pa.Table:
    """`table` with double columns; NaN is null."""
    for c, v in made.items():
        table = table.append_column(c, pa.array(np.asarray(v, float), pa.float64(), from_pandas=True))
    return table


def map_blocks(cur: DataFrame, ent: Ent, needs: Sequence[str], make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], outs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A block's rows in order, halo rows first, through `make` (arrays to arrays of the same length); own rows come out with `outs`.

    Of the helper columns those in `keep` stay.
    """
    helpers = [c for c in ("_pos", "_block", "_own") if c not in keep]
    fields = [f for f in cur.schema.fields if f.name not in helpers]
    schema = StructType(fields)
    for c in outs:
        schema = schema.add(c, "double")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        if not pc.any(table.column("_own")).as_py():  # copies behind an entity's last row
            table = table.slice(0, 0)
        made = make(numbers(table, needs)) if len(table) else {c: [] for c in outs}
        done = with_columns(table, {c: made[c] for c in outs})
        return done.filter(table.column("_own")).drop_columns(helpers)

    return cur.groupBy(*ent, "_block").applyInArrow(run, schema)
