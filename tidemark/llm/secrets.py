"""Secret scan with multipart credential linking, in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, spread

# Kind, pattern, the group whose length counts (0: the whole match), the least such length.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Weak candidates: reported only beside the parts that they need.
WEAK = (
    ("ident", r"(?i)\b(?:user(?:name)?|login|client_?id|account)\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", 1, 3),
    ("secret", r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0, 40),
    ("endpoint", r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20\"'<>]+", 0, 8),
)
KINDS = BASE + WEAK
#: What a text must hold for a kind's pattern to match; saves its passes over most texts.
HINTS = {"access": "AKIA", "endpoint": "://"}
#: Code points between the starts of two parts of one credential.
SCOPE = 400


def _hits(text, kind: str, rank: int, pattern: str, group: int):
    """Array of (kind, rank, index, length ahead, length, length that counts) of all matches; no matched text is kept."""
    gaps = F.split(text, pattern, -1)
    n = F.size(gaps) - 1
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    part = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else whole
    rows = F.transform(
        F.arrays_zip(F.slice(F.transform(gaps, F.char_length), F.lit(1), n).alias("gap"), whole.alias("hit"), part.alias("ok")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("i"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["ok"].alias("ok")
        ),
    )
    # most texts have no match: they cost one search, not a split and the extractions
    there = F.contains(text, F.lit(HINTS[kind])) & text.rlike(pattern) if kind in HINTS else text.rlike(pattern)
    return F.when(there, rows)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, parts): a row number per document, and every match with its code point interval.

    A match's start is the sum of the gaps and matches ahead of it, taken by a window over the
    document's own matches. Matches whose counted length is too short only take up their room.
    """
    text = F.coalesce("_text", F.lit(""))
    lists = [_hits(text, kind, i, pattern, group) for i, (kind, pattern, group, _) in enumerate(KINDS)]
    slim = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).select("doc_id", *[x.alias(f"m{i}") for i, x in enumerate(lists)])
    found = F.filter(F.array(*[f"m{i}" for i in range(len(KINDS))]), lambda x: x.isNotNull())
    rows = materialize(
        slim.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.flatten(found).alias("parts")), "parts"
    )
    ahead = Window.partitionBy("rid", "rank").orderBy("i")
    least = reduce(lambda c, x: c.when(F.col("rank") == x[0], x[1][3]), enumerate(KINDS), F)
    parts = (
        rows.select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(ahead).cast("long"))
        .filter(F.col("ok") >= least)
        .select("rid", "kind", "rank", (F.col("end") - F.col("hit")).alias("start"), "end")
    )
    return rows.select("rid", "doc_id"), parts


def link_credentials(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base matches, and the weak candidates that complete a credential.

    The parts of a document are joined by interval: two parts meet when their starts lie within
    `scope` code points. An `ident` needs a secret (assign, hex, secret), a `secret` needs an
    identifier (access, ident), an `endpoint` needs both. The join is a range frame over the
    document's parts, so it counts partners and never emits pairs. A candidate that overlaps a
    base match is that match, and isn't reported again.
    """
    near = Window.partitionBy("rid").orderBy("start").rangeBetween(-scope, scope)
    order = Window.partitionBy("rid").orderBy("start", "rank", "end")
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("rank"), F.desc("end"))
    base = F.col("rank") < len(BASE)
    met = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    need = (
        F.when(base, F.lit(True)).when(F.col("kind") == "ident", F.col("_secret"))
        .when(F.col("kind") == "secret", F.col("_id")).otherwise(F.col("_id") & F.col("_secret"))
    )
    return (
        parts.withColumn("_id", met("access", "ident")).withColumn("_secret", met("assign", "hex", "secret"))
        .withColumn("_ends", F.coalesce(F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
        .withColumn("_next", F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)))
        .filter(base | (need & (F.col("_ends") <= F.col("start")) & (F.coalesce(F.col("_next"), F.col("end")) >= F.col("end"))))
        .select("rid", "kind", "rank", "start", "end")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: counts of base matches, their digest, and all spans.

    Null or empty text: no spans, digest of the empty string. Repeated rows each get a row.
    Ties in start are in the order of KINDS, then by end. Empty table: no rows. A very long
    text is one row like any other; only its matches' lengths are kept.
    """
    rows, parts = find_parts(docs, id_col, text_col)
    text = lambda keep: F.array_join(
        F.transform(F.filter("s", keep), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    spans = link_credentials(parts, scope).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("s"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    return rows.join(spans, "rid", "left").withColumn("s", F.coalesce("s", none)).select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(text(lambda x: x["rank"] < len(BASE)).cast("binary"), 256).alias("base_sha256"), text(lambda x: F.lit(True)).alias("spans"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
