"""Quality rules per document and per host."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow_rows import map_rows
from tidemark.llm.shared import broadcast_if_small, materialize

# Fixed values of the rules.
BLANKS, SYMBOLS = " \t\n\v\f\r", b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Host rules: a document fails `symbols` over this share of words, `lines` over this share of lines.
MAX_SYMBOLS, MAX_DUP_LINES = 0.1, 0.3
RULES = ("short", "repeat", "symbols", "lines")
#: A host fails when a rule's shrunk failure rate is above this.
MAX_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 1e6


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(doc_id, source, text):
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        doc_id, source, len(words), len(text) - sum(map(text.count, BLANKS)), sum(raw.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


MEASURES = "doc_id bigint, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def failures(measured: DataFrame) -> DataFrame:
    """Add fail_<rule> (0 or 1) and base_failed."""
    fails = {
        "short": F.col("n_words") < MIN_WORDS,
        "repeat": F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT,
        "symbols": F.col("n_symbols") > F.col("n_words") * MAX_SYMBOLS,
        "lines": F.col("n_dup_lines") > F.col("n_lines") * MAX_DUP_LINES,
    }
    return measured.select("*", *[fails[r].cast("int").alias(f"fail_{r}") for r in RULES], (fails["short"] | fails["repeat"]).alias("base_failed"))


def host_verdicts(failed: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per source: n, and per rule rate_<rule>, the failure rate shrunk to the rate of all hosts; host_failed.

    The beta prior of a rule has the mean m of all documents and the weight k for which the
    variance of host rates beyond chance is m(1-m)/(k+1) (method of moments). Sums per host are
    made before the shuffle, so a host with a third of all documents costs no more than others.
    """
    hosts = materialize(failed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"fail_{r}").alias(r) for r in RULES]), "hosts")
    whole = hosts.agg(F.count(F.lit(1)).alias("_h"), F.sum("n").alias("_n"), *[(F.sum(r) / F.sum("n")).alias(f"_m_{r}") for r in RULES])
    spread = hosts.join(F.broadcast(whole)).agg(  # one row
        F.first("_h").alias("_h"), F.first("_n").alias("_n"), *[F.first(f"_m_{r}").alias(f"_m_{r}") for r in RULES],
        *[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.col(f"_m_{r}"), 2)).alias(f"_s_{r}") for r in RULES],
    )
    noise = lambda r: F.col(f"_m_{r}") * (1 - F.col(f"_m_{r}"))
    beyond = lambda r: (F.col(f"_s_{r}") - noise(r) * (F.col("_h") - 1)) / F.col("_n")
    weight = lambda r: F.when(beyond(r) > 0, F.greatest(F.lit(PRIOR_MIN), F.least(F.lit(PRIOR_MAX), F.try_divide(noise(r), beyond(r)) - 1))).otherwise(PRIOR_MAX)
    rates = hosts.join(F.broadcast(spread)).select(
        "source", "n", *[((F.col(r) + F.col(f"_m_{r}") * weight(r)) / (F.col("n") + weight(r))).alias(f"rate_{r}") for r in RULES]
    )
    return rates.withColumn("host_failed", F.greatest(*[f"rate_{r}" for r in RULES]) > max_rate)


def score_quality(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Measures, base_failed, the host's shrunk rates and kept, per document.

    Null text: all measures 0, so base_failed. Null source: a host of its own. Repeated rows
    each count. A text without line breaks is one line. Empty table: no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    failed = failures(materialize(map_rows(slim, lambda: measure, MEASURES), "measures"))
    hosts = broadcast_if_small(host_verdicts(failed).select(F.col("source").alias("_source"), *[f"rate_{r}" for r in RULES], "host_failed"))
    return failed.join(hosts, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_RATE = "(h.{r} + m_{r} * k_{r}) / (h.n + k_{r})"
_K = """CASE WHEN s_{r} > m_{r} * (1 - m_{r}) * (hn - 1)
 THEN greatest(2.0, least(1e6, m_{r} * (1 - m_{r}) / ((s_{r} - m_{r} * (1 - m_{r}) * (hn - 1)) / dn) - 1)) ELSE 1e6 END AS k_{r}"""
OP2_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM ws),
tri AS (SELECT rid, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
many AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri WHERE g IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM many, unnest([0, 1, 2]) AS x(k) WHERE c > 1 GROUP BY rid),
b AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_once,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN ws USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_lines - n_once AS n_dup_lines, (n_words < 50)::INT AS short, (n_repeat_words * 100 > n_words * 50)::INT AS rep,
        (n_symbols > n_words * 0.1::DOUBLE)::INT AS sym, (n_lines - n_once > n_lines * 0.3::DOUBLE)::INT AS lin FROM b),
h AS (SELECT source, count(*) AS n, sum(short) AS short, sum(rep) AS rep, sum(sym) AS sym, sum(lin) AS lin FROM f GROUP BY source),
m AS (SELECT count(*) AS hn, sum(n) AS dn, """
    + ", ".join(f"sum({r}) / sum(n) AS m_{r}" for r in ("short", "rep", "sym", "lin"))
    + " FROM h),\ns AS (SELECT any_value(m) AS m, "
    + ", ".join(f"sum(n * power({r} / n - m_{r}, 2)) AS s_{r}" for r in ("short", "rep", "sym", "lin"))
    + " FROM h, m),\nk AS (SELECT *, "
    + ", ".join(_K.format(r=r) for r in ("short", "rep", "sym", "lin"))
    + " FROM s, m),\nv AS (SELECT source, greatest("
    + ", ".join(_RATE.format(r=r) for r in ("short", "rep", "sym", "lin"))
    + """) > 0.5 AS host_failed FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short + rep > 0 AS base_failed,
  short + rep = 0 AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
)
