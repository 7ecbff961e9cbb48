"""Benchmark decontamination by canonical templates, in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import broadcast_if_small, materialize, row_key, spread

#: Words in a window, and the share of an item's windows that a document must hold.
WINDOW, COVER = 5, 0.8
#: A window of an item counts only with this many words that aren't placeholders, if the item has such a window.
LITERALS = 3
#: Parts of a window's documents where the items are too many for a broadcast.
SALT = 16
# Words that begin a sentence with a capital and are no names.
OPENERS = (
    "A|An|The|This|That|These|Those|There|Here|It|He|She|They|We|You|If|When|While|After|Before|Then|In|On|At|By|For|From|To|Of|With|As|And|But|Or|So|"
    "How|What|Which|Who|Why|Where|Each|Every|All|Some|One|Two|Find|Let|Is|Are|Was|Were|Do|Does|Did|Can|Could|Will|Would|His|Her|Their|Its|Our|Your|My|Not|No"
)
# Units of measure that may follow a number.
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|oz|ms|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|"
    "mph|kmh|miles?|feet|ft|inch(?:es)?|l|ml|litres?|liters?|usd|eur|dollars?|euros?|cents?|percent|degrees?"
)


def marked(text: Column) -> Column:
    """Text in lower case, words apart by one space; slots are words that begin with U+0001 and n, u or p.

    Numbers (with their separators), units behind numbers, and names (capitalised words that
    aren't usual openers of a sentence) are slots and keep their value.
    """
    numbers = F.regexp_replace(text, r"(?<=\d)[.,](?=\d)", "\u0002")
    numbers = F.regexp_replace(numbers, rf"(?<![\p{{L}}\p{{N}}])(\d[\d\u0002]*)\x20?({UNITS})(?![\p{{L}}\p{{N}}])", " \u0001n$1 \u0001u$2 ")
    numbers = F.regexp_replace(numbers, r"(?<![\p{L}\p{N}\u0002])(\d[\d\u0002]*)(?![\p{L}\p{N}\u0002])", " \u0001n$1 ")
    t = F.when(text.rlike(r"\d"), numbers).otherwise(text)
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}\u0001])(?!(?:{OPENERS})(?!\p{{L}}))(\p{{Lu}}\p{{L}}+)", "\u0001p$1")
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\u0001\u0002]+", " "))


def template_windows(df: DataFrame, text_col: str, keep: list[Column], pos: str, sizes: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """Rows (keep..., pos, n, h): the hash of every window of n template words, for each n of `sizes`."""
    marks = df.select(*keep, marked(F.coalesce(F.col(text_col), F.lit(""))).alias("_m"))
    names = [c for c in marks.columns if c[0] != "_"]
    arrays = marks.select(*names, F.split(F.regexp_replace("_m", "\u0001([nup])[^ ]*", "\u0001$1"), " ").alias("_t")).filter(F.size("_t") >= min(sizes))

    def windows(size: int) -> Column:
        h = lambda i: F.xxhash64(*[F.get("_t", i + k) for k in range(size)])
        each = F.transform(F.sequence(F.lit(0), F.size("_t") - size), lambda i: F.struct(i.alias("p"), F.lit(size).alias("n"), h(i).alias("h")))
        return F.when(F.size("_t") >= size, each)

    each = windows(sizes[0]) if len(sizes) == 1 else F.flatten(F.filter(F.array(*[windows(n) for n in sizes]), lambda x: x.isNotNull()))
    return arrays.select(*names, F.explode(each).alias("_w")).select(*names, F.col("_w.p").alias(pos), "_w.n", "_w.h")


def slot_values(df: DataFrame, key: str, text_col: str, places: DataFrame) -> DataFrame:
    """(key, pos, n, slots): the values of the slots in the windows at `places` (key, pos, n), in order.

    Rows with one key have one text. A text is taken once with all its places, so it isn't copied for each.
    """
    wanted = places.distinct().groupBy(key).agg(F.collect_list(F.struct("pos", "n")).alias("_at"))
    rows = df.join(broadcast_if_small(places.select(key).distinct()), key, "left_semi").groupBy(key).agg(F.first(text_col).alias("_text"))
    each = rows.join(wanted, key).withColumn("_v", F.split(marked(F.coalesce("_text", F.lit(""))), " ")).select(
        key, F.explode(F.transform("_at", lambda a: F.struct(a["pos"].alias("pos"), a["n"].alias("n"), F.slice("_v", a["pos"] + 1, a["n"]).alias("w")))).alias("_x")
    )
    return each.select(key, "_x.pos", "_x.n", F.filter("_x.w", lambda v: v.startswith("\u0001")).alias("slots"))


def item_windows(benchmark: DataFrame, item_col: str, item_text: str, size: int) -> DataFrame:
    """(item_id, variant, item_pos, n, h, item_slots, strict, n_windows): an item as it stands and, where that differs, in lower case.

    A text in lower case has no names; the second variant finds it. Items under `size` words
    are one window of all their words. Windows with under LITERALS plain words say little and
    are left out; an item that has no others keeps them all, but strict: with equal values.
    """
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("_text")).distinct()
    lower = rows.filter(F.lower("_text") != F.col("_text")).select("item_id", F.lit(1), F.lower("_text"))
    texts = rows.select("item_id", F.lit(0).alias("variant"), "_text").union(lower).withColumn("_key", F.xxhash64("item_id", "variant", "_text"))
    texts = materialize(texts.withColumn("_n", F.size(F.split(marked(F.col("_text")), " "))), "item-texts")
    keep = [F.col("item_id"), F.col("variant"), F.col("_key").alias("key")]
    parts = [template_windows(texts.filter(F.col("_n") >= size), "_text", keep, "pos", (size,))]
    parts += [template_windows(texts.filter(F.col("_n") == n), "_text", keep, "pos", (n,)) for n in range(LITERALS, size)]
    found = reduce(DataFrame.union, parts)
    slots = slot_values(texts.withColumnRenamed("_key", "key"), "key", "_text", found.select("key", "pos", "n"))
    valued = found.join(slots, ["key", "pos", "n"]).withColumn("_few", F.size("slots") > F.col("n") - LITERALS)
    whole = valued.groupBy("key").agg(F.every("_few").alias("strict"), F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("_few")).alias("_told"))
    kept = valued.join(whole, "key").filter("strict OR NOT _few").withColumn("n_windows", F.when(F.col("strict"), F.col("_all")).otherwise(F.col("_told")))
    return kept.select("item_id", "variant", F.col("pos").alias("item_pos"), "n", "h", F.col("slots").alias("item_slots"), "strict", "n_windows")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    size: int = WINDOW, cover: float = COVER,
) -> DataFrame:
    """Pairs (doc_key, doc_id, item_id) with n_windows, n_found, coverage, n_slots and kind.

    Windows of both sides are joined by hash; along each alignment (distance between the places
    in document and item) the item's slot values must map to one value each in the document,
    else the alignment doesn't count. A pair is reported when consistent alignments hold at
    least `cover` of the item's windows. kind: `verbatim` if all slot values are equal, else
    `re-parameterised`.

    Null texts hold nothing. Items of LITERALS to `size` - 1 words are found whole; items of
    fewer words name nothing and are never found. Repeated rows (equal id and text) share
    doc_key and give one pair. Items with equal text are each reported; an item with two texts
    is found by either. Empty tables: no rows. Clashing column names in the inputs are not read.
    """
    items = materialize(item_windows(benchmark, item_col, item_text, size), "item-windows")
    short = tuple(sorted(r["n"] for r in items.filter(F.col("n") < size).select("n").distinct().collect()))  # at most two sizes
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).withColumn("doc_key", row_key(F.col("doc_id"), F.col("_text")))
    wins = template_windows(texts, "_text", [F.col("doc_key"), F.col("doc_id")], "doc_pos", (size, *short))
    side = broadcast_if_small(items)
    if side is items:  # a window that very many documents or items share is several tasks' work
        wins = wins.withColumn("_salt", F.pmod("doc_key", F.lit(SALT)))
        side = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    met = materialize(wins.join(side, [c for c in ("h", "n", "_salt") if c in wins.columns]).drop("_salt", "h").distinct(), "met-windows")
    # only windows that met an item with slots need the values of the document
    places = met.filter(F.size("item_slots") > 0).select("doc_key", F.col("doc_pos").alias("pos"), "n")
    values = slot_values(texts.select("doc_key", "_text"), "doc_key", "_text", places).withColumnRenamed("pos", "doc_pos")
    none = F.array().cast("array<string>")
    hits = met.join(values, ["doc_key", "doc_pos", "n"], "left").select(
        "doc_key", "doc_id", "item_id", "variant", "n_windows", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("diag"),
        F.arrays_zip(F.col("item_slots").alias("i"), F.coalesce("slots", none).alias("d")).alias("pairs"), "strict",
    )
    hits = hits.filter(~F.col("strict") | F.forall("pairs", lambda p: p["i"].eqNullSafe(p["d"])))
    pair = ["doc_key", "doc_id", "item_id", "variant", "n_windows"]
    per_diag = (
        hits.groupBy(*pair, "diag")
        .agg(F.collect_list("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
        .filter(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))))
    )
    same = F.forall("pairs", lambda p: p["i"].eqNullSafe(p["d"]))
    found = (
        per_diag.groupBy(*pair)
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_found"),
             F.max(F.size("pairs")).cast("long").alias("n_slots"), F.min(same).alias("_same"))
        .withColumn("coverage", F.col("n_found") / F.col("n_windows"))
        .filter(F.col("coverage") >= cover)
    )
    kind = F.when(F.col("_same"), F.lit("verbatim")).otherwise(F.lit("re-parameterised")).alias("kind")
    best = F.max_by(F.struct("n_windows", "n_found", "coverage", "n_slots", kind), F.struct("coverage", -F.col("variant"))).alias("_b")
    return found.groupBy("doc_key", "doc_id", "item_id").agg(best).select("doc_key", "doc_id", "item_id", "_b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item is found, with the columns of `docs`.

    Null and empty texts hold no item and stay; repeated rows go or stay together; null ids are
    ids like others. Empty documents: no rows. Empty benchmark: all rows.
    """
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_key").alias("_bad")).distinct()
    return docs.join(bad, row_key(docs[id_col], docs[text_col]) == F.col("_bad"), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, bench).drop("doc_key")
