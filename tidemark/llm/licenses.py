"""Licence scan: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow_rows import map_rows

# Phrase (words apart by one space), label, weight. The first three are the base.
BASE_PHRASES = (("mit license", "mit", 0.9), ("apache license", "apache", 0.9), ("general public license", "gpl", 0.9))
NOTICES = (
    ("permission is hereby granted free of charge", "mit", 0.8),
    ("redistribution and use in source and binary forms", "bsd", 0.8),
    ("bsd license", "bsd", 0.8),
    ("isc license", "isc", 0.8),
    ("lesser general public license", "lgpl", 0.9),
    ("affero general public license", "agpl", 0.9),
    ("mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.9),
    ("boost software license", "bsl", 0.8),
    ("creative commons attribution", "cc-by", 0.7),
    ("cc by", "cc-by", 0.7),
    ("cc by nc", "cc-by-nc", 0.8),
    ("cc by nd", "cc-by-nd", 0.8),
    ("cc by sa", "cc-by-sa", 0.8),
    ("cc0 1 0", "cc0", 0.8),
    ("released into the public domain", "public-domain", 0.7),
    ("this is free and unencumbered software", "unlicense", 0.8),
    ("all rights reserved", "proprietary", 0.5),
)
#: The identifier tag as words, and what may follow it: one line's worth of names, brackets and operators.
TAG_WORDS = "spdx license identifier"
#: A slash between two names is an older way to write `or`.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*((?:[A-Za-z0-9.+()\-: \t]|(?<=[A-Za-z0-9.+)])/(?=[A-Za-z0-9(]))+)", re.ASCII | re.I)
TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+:\-]+")
#: An expression with more choices counts as this many.
MOST_CHOICES = 10**15
#: Families of identifiers by their start, the most special first.
FAMILIES = (
    ("AGPL", "agpl"), ("LGPL", "lgpl"), ("GPL", "gpl"), ("Apache", "apache"), ("MIT", "mit"), ("BSD", "bsd"), ("ISC", "isc"), ("MPL", "mpl"),
    ("EPL", "epl"), ("BSL", "bsl"), ("CC0", "cc0"), ("CC-BY-NC", "cc-by-nc"), ("CC-BY-ND", "cc-by-nd"), ("CC-BY-SA", "cc-by-sa"), ("CC-BY", "cc-by"), ("Unlicense", "unlicense"),
)
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def family(identifier: str) -> str:
    """Label of an identifier: its family's where no letter follows the family's name (but a version's v), else itself."""
    name = identifier.lower()
    return next((label for start, label in FAMILIES if re.match(re.escape(start.lower()) + r"(?:v?\d|[^a-z]|$)", name)), name)


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: names and operators of a licence expression in postfix order; None if malformed.

    Trailing text behind a complete expression is prose and ends it.
    """
    out, stack, wants_name = [], [], True
    for token in TOKEN.findall(expression):
        token = "OR" if token == "/" else token
        op = token.upper()
        if wants_name:
            if token == "(":
                stack.append("(")
            elif token == ")" or op in PRECEDENCE:
                return None
            else:
                out.append(token)
                wants_name = False
        elif op in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
            wants_name = True
        elif token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
    if wants_name or "(" in stack:
        return None
    return out + stack[::-1]


def completed(expression: str) -> str:
    """An expression that a line's end cut off: operators without a right side go, open brackets are closed."""
    tokens = TOKEN.findall(expression)
    while tokens and (tokens[-1] in ("(", "/") or tokens[-1].upper() in PRECEDENCE):
        tokens.pop()
    return " ".join(tokens) + " )" * max(0, tokens.count("(") - tokens.count(")"))


def evaluate(postfix: list[str]) -> tuple[int, frozenset[str]]:
    """How many choices an expression leaves (`or` adds, `and` multiplies; MOST_CHOICES at most), and all labels in it.

    `with` keeps the licence's label and drops the exception's name.
    """
    stack: list[tuple[int, set[str]]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (n, right), (m, left) = stack.pop(), stack.pop()
            if token != "WITH":
                small, left = sorted((left, right), key=len)
                left |= small  # the larger set grows, so long expressions stay cheap
                m = min(m + n if token == "OR" else m * n, MOST_CHOICES)
            stack.append((m, left))
        else:
            stack.append((1, {family(token)}))
    return stack[0][0], frozenset(stack[0][1])


def make_scan(phrases=BASE_PHRASES + NOTICES, n_base: int = len(BASE_PHRASES)):
    """The scan of one text, with its automaton of notices and the identifier tag built once per task."""
    tree = ahocorasick.Automaton()
    for i, (phrase, label, weight) in enumerate((*phrases, (TAG_WORDS, "", 0.0))):
        tree.add_word(f" {phrase} ", (i, len(phrase) + 1, phrase.count(" ") + 1, label, weight))
    tree.make_automaton()

    def scan(doc_id, text):
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        hits, tagged, word, at = [], False, 0, 0
        for end, (i, size, n, label, weight) in tree.iter(flat):
            word, at = word + flat.count(" ", at, end), end  # blanks ahead of the one that ends the match
            if i == len(phrases):
                tagged = True
            else:
                hits.append((word - n, word, i, label, weight))
        base = [h for h in hits if h[2] < n_base]
        labels: dict[str, float] = {}
        for hit in longest(hits):
            labels[hit[3]] = max(hit[4], labels.get(hit[3], 0))
        labels |= {h[3]: max(h[4], labels.get(h[3], 0)) for h in base}
        choices = 0
        for m in TAG.finditer(text) if tagged else ():
            if postfix := to_postfix(m[1]) or to_postfix(completed(m[1])):
                n, found = evaluate(postfix)
                choices = max(choices, n)
                labels |= dict.fromkeys(found, 1.0)
        miss = 1.0
        for weight in labels.values():
            miss *= 1 - weight
        return (
            doc_id, len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
            ",".join(sorted({h[3] for h in base})), ",".join(sorted(labels)), 1 - miss if labels else 0.0, float(choices),
        )

    return scan


def longest(hits: list[tuple]) -> list[tuple]:
    """The hits (first word, last word + 1, ...) that don't lie inside a longer one; a notice in a longer one is that one."""
    out, upto = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[1] > upto:
            out.append(hit)
            upto = hit[1]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, base places, labels, a score in [0, 1] and the number of choices of its widest expression.

    Labels come from notices that aren't part of a longer one, from all base places and from
    expressions behind an identifier tag in any case. score = 1 - product of (1 - weight) over the labels. Null or empty text: no words, no
    labels, score 0, places null. Repeated rows each get a row; texts are read whole. Labels
    are distinct and sorted by code point. Empty table: no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(
        slim, make_scan,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_choices double",
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
