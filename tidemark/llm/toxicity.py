"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow_rows import map_rows
from tidemark.llm.shared import materialize, spread

# Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "ս": "u", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
    **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
})
NON_LATIN = re.compile("[ɑɡıͰ-֏ⅼ＀-￯]")
#: Digits and signs written for letters; i, l and 1 become one letter in lexicon and text alike.
FOLD_FROM, FOLD_TO = b"0134578@$l", b"oieastbasi"
FOLD = bytes.maketrans(FOLD_FROM, FOLD_TO)
FOLD = bytes(FOLD[b] if b > 127 or chr(b).isalnum() or b in b"@$" else 32 for b in range(256))
#: Terms for a corpus without usable labels.
SEED_TERMS = ("idiot", "moron", "scum", "worthless", "pathetic", "loser", "stupid", "disgusting")
#: Phrases in which a term is meant otherwise; a term inside one doesn't count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum line", "pond scum", "stupid question", "sore loser award")
#: Bound of the labelled rows that the lexicon is learned from (the rows with the smallest hashes).
SAMPLE_ROWS = 20_000
#: A term must stand in this share of the toxic texts (and three), be this much likelier there,
#: and have this log-likelihood ratio (G2) against chance, which a few copies don't reach.
MIN_SHARE, MIN_ODDS, MIN_G2 = 0.01, 30.0, 20.0
STEMS = (4, 5, 6, 7)
#: Terms that a task counts before it passes them on.
COUNTED = 200_000


def fold(text: str) -> str:
    """Lower case, look-alike letters and digits made Latin, all else in ASCII made blank."""
    text = text.lower()
    if not text.isascii() and NON_LATIN.search(text):
        text = text.translate(HOMOGLYPHS)
    return text.encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Lexicon:
    """terms: (folded term, is a stem, weight); the logistic map's bias and slopes; exception phrases."""

    terms: tuple[tuple[str, bool, float], ...]
    bias: float
    slopes: tuple[float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


def make_raw(lexicon: Lexicon):
    """The function from a text to (weight found, words), with its automaton built once per task."""
    tree = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        tree.add_word(f" {' '.join(fold(phrase).split())} ", (0, len(phrase) + 2, 0.0))
    for term, stem, weight in lexicon.terms:
        key = f" {term}" if stem else f" {term} "
        tree.add_word(key, (1, len(key), weight))
    tree.make_automaton()

    def raw(text):
        words = fold(text or "").split()
        found, spared = [], []
        for end, (kind, size, weight) in tree.iter(f" {' '.join(words)} "):
            (found if kind else spared).append((end - size + 1, end, weight))
        if spared:
            found = outside(found, spared)
        best: dict[int, float] = {}
        for start, _, weight in found:  # a word counts once, with its heaviest term
            best[start] = max(weight, best.get(start, 0.0))
        return sum(best.values()), len(words)

    return raw


def outside(found: list[tuple], spared: list[tuple]) -> list[tuple]:
    """The spans of `found` that no span of `spared` holds, by one walk over both in order of start."""
    out, at, reach = [], 0, -1
    spared = sorted(spared)
    for x in sorted(found):
        while at < len(spared) and spared[at][0] <= x[0]:
            reach = max(reach, spared[at][1])
            at += 1
        if x[1] > reach:
            out.append(x)
    return out


def features(weight: float, words: int) -> tuple[float, float]:
    """Weight found, and weight for 100 words, both on a log scale."""
    return math.log1p(weight), math.log1p(100 * weight / max(words, 1))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, at in zip(batch.column(0).to_pylist(), range(batch.num_rows)):
            words = set(fold(text or "").split())
            terms = {f"{w} " for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}
            key = min((crc32(w.encode("utf-8", "surrogatepass")) for w in words), default=0)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(terms), pa.string()), pa.array([key] * len(terms), pa.int64())], ["term", "key"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (term, n): parts of the number of texts with each term."""
    counts: dict[str, int] = {}

    def passed_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = set(fold(text or "").split())
            for term in {f"{w} " for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}:
                counts[term] = counts.get(term, 0) + 1
            if len(counts) >= COUNTED:
                yield passed_on()
    yield passed_on()


def _maybe_good(n_toxic: int, n_clean: int) -> Column:
    """Whether (t, c) can pass MIN_ODDS and MIN_G2, with room for rounding: choose_terms decides."""
    t, c = F.col("t"), F.col("c")
    odds = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
    part = lambda n, of: F.when(n > 0, n * F.log(n * float(n_toxic + n_clean) / (of * (t + c)))).otherwise(0.0)
    return (odds >= MIN_ODDS * (1 - 1e-9)) & (2 * (part(t, float(n_toxic)) + part(c, float(n_clean))) >= MIN_G2 * (1 - 1e-9))


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Terms with enough support and odds; a stem stands for its words only where it reaches further.

    counts: (term, toxic texts, clean texts); whole words end in a blank.
    """
    odds = lambda t, c: ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
    part = lambda n, of, share: n * math.log(n / (of * share)) if n else 0.0
    g2 = lambda t, c: 2 * (part(t, n_toxic, (t + c) / (n_toxic + n_clean)) + part(c, n_clean, (t + c) / (n_toxic + n_clean)))
    good = {
        term: (t, math.log(o)) for term, t, c in counts
        if t >= max(3, MIN_SHARE * n_toxic) and (o := odds(t, c)) >= MIN_ODDS and g2(t, c) >= MIN_G2
    }
    most: dict[str, int] = {}  # the most texts of a longer term that begins so
    for term, (t, _) in good.items():
        for k in range(1, len(term)):
            most[term[:k]] = max(t, most.get(term[:k], 0))
    begins = lambda term, among: any(term[:k] in among for k in range(1, len(term)))
    stems = {term: v for term, v in good.items() if term[-1] != " " and most.get(term, 0) < 0.9 * v[0]}
    kept = {s: v for s, v in stems.items() if not begins(s, stems)}
    whole = {t: v for t, v in good.items() if t[-1] == " " and not begins(t, kept)}
    return [(t, True, round(v[1], 6)) for t, v in sorted(kept.items())] + [(t.strip(), False, round(v[1], 6)) for t, v in sorted(whole.items())]


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and slopes by damped Newton steps on the mean log loss of rows that count n times, with a small ridge."""
    a, n = np.column_stack([np.ones(len(x)), x]), n / n.sum()
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + ridge / 10 * np.eye(a.shape[1])
        step = np.linalg.solve(hess, a.T @ (n * (p - y)) + ridge / 10 * beta)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Lexicon and calibration from the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most about `bound` labelled documents are used, chosen by a hash of the id. Support is
    counted over distinct smallest word hashes, so that copies of one text don't vote often.
    Without both classes the seed terms get weight 1 and a fixed map. Ids with several labels
    count as toxic if one says so; null labels and ids aren't used.
    """
    usable = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("_id IS NOT NULL AND toxic IS NOT NULL").filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("_id").agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, bound / max(usable.count(), 1))
    chosen = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # at most about `bound` ids; equal rows of an id count once, and an id's different texts each
    sample = materialize(texts.join(F.broadcast(chosen), "_id").distinct().select("text", "toxic"), "toxic-sample")
    toxic, clean = (sample.filter(F.col("toxic") == y).select("text") for y in (1, 0))
    n_clean = clean.count()
    support = materialize(toxic.mapInArrow(_candidates, "term string, key long").groupBy("term").agg(F.countDistinct("key").alias("n")), "terms")
    n_toxic = toxic.count()
    terms: list[tuple[str, bool, float]] = []
    if n_toxic and n_clean:
        floor = max(3, math.ceil(MIN_SHARE * n_toxic))
        frequent = support.filter(F.col("n") >= floor).select("term", F.col("n").alias("t"))
        seen = clean.mapInArrow(_count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("c"))
        tested = frequent.join(seen, "term", "left").select("term", "t", F.coalesce("c", F.lit(0)).alias("c"))
        # each stands in 1 % of the toxic texts: at most 100 times the terms of an average one
        terms = choose_terms([tuple(r) for r in tested.filter(_maybe_good(n_toxic, n_clean)).collect()], n_toxic, n_clean)
    if not terms:
        return Lexicon(tuple((fold(t), False, 1.0) for t in SEED_TERMS), -2.0, (2.0, 1.0))
    draft = Lexicon(tuple(terms), 0.0, (0.0, 0.0))

    def make():
        raw = make_raw(draft)
        return lambda text, y: (*features(*raw(text)), float(y))

    # equal measures are one row with a weight: the fit sees counts, not documents
    measured = map_rows(sample, make, "a double, b double, y double").groupBy(F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "y").agg(F.count(F.lit(1)).alias("n"))
    rows = np.array([tuple(r) for r in measured.collect()], float)
    beta = fit_logistic(rows[:, :2], rows[:, 2], rows[:, 3])
    return Lexicon(tuple(terms), float(beta[0]), (float(beta[1]), float(beta[2])))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score in [0, 1], predicted.

    Null and empty texts find nothing and score as such. Texts are read whole; a word counts
    once, with its heaviest term. Repeated rows each get a row. A null id is not held out.
    Empty table: no rows.
    """
    slim = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def make():
        raw = make_raw(lexicon)

        def score(doc_id, text):
            a, b = features(*raw(text))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, lexicon.bias + lexicon.slopes[0] * a + lexicon.slopes[1] * b))))
            return doc_id, doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0, p, int(p >= 0.5)

        return score

    return map_rows(slim, make, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of `docs`.

    Each row is judged by its text alone: null ids and repeated rows make no difference. Null
    and empty texts find nothing and stay, unless the lexicon's map calls such texts toxic.
    Empty table: no rows.
    """

    def make():
        raw = make_raw(lexicon)
        return lambda text: lexicon.bias + float(np.dot(lexicon.slopes, features(*raw(text)))) >= 0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([not toxic(t) for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, learn(docs, labels))
