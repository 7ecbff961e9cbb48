"""Conversation trie: brute force on odd rows and hot prefixes, SQL, the hash table and the digests of ends."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from tests.helpers import oracle_rows, rows_of
from tidemark.llm import trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(donor, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children[p])
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=str,
    )


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def some(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-9, 90), 200, 203, 1007]:
        if c % 11 == 4:
            continue  # absent ones, donors too
        common = rng.random() < 0.4
        for t in range(rng.randrange(1, 14)):
            text = f"turn {t}" if common else f"turn {t} é {rng.randrange(3)}"
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None, ""]) if t % 5 == 4 else "user", None if rng.random() < 0.05 else text))
    rows += [(60, 1, "user", "turn 1")] * 3 + [(None, 0, "user", "x")]
    rows += [(2000, t, "user", f"turn {t}") for t in range(150)]
    return rows


@pytest.mark.parametrize("heavy", [trie.HEAVY, 6])
def test_equals_brute_force(spark, heavy):
    rows = some(heavy)
    assert got(trie.conversation_trie(frame(spark, rows).repartition(5), heavy=heavy)) == plain(rows)


def test_colliding_digests_are_found_and_hashed_anew(spark):
    rows = some(3)
    prefixes = trie.rebuilt_prefixes(frame(spark, rows), width=3)[1]
    assert not trie.distinct_nodes(prefixes)[1]
    assert got(trie.conversation_trie(frame(spark, rows), width=3)) == plain(rows)


def test_query_equals_sql(spark):
    expected, names = oracle_rows(trie.OP13_SQL, SF)
    assert rows_of([r.asDict() for r in trie.op13_trie(spark, SF).collect()], names) == rows_of(expected, names)


def test_empty_table_and_turnless_conversations(spark):
    assert trie.conversation_trie(frame(spark, [(1, 0, "u", "x")]).filter("conv_id < 0")).count() == 0
    turnless = next(c for c in range(1, 99) if c % 5 and crc32(str(c).encode()) % 9 > 2)
    rows = [(turnless, 0, "u", "only")]  # its donor is absent, its own turn lies in the head
    assert got(trie.conversation_trie(frame(spark, rows))) == plain(rows) and len(plain(rows)) == 1


def test_minimal_hash_gives_each_key_a_slot():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64))
    table = trie.MinimalHash(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    assert len(trie.MinimalHash(keys[:0]).slots(keys[:2])) == 2


def test_ends_of_one_node_pass_in_numeric_order(spark):
    ends = spark.range(30_000).selectExpr("1L AS depth", "5L AS a", "6L AS b", "id - 7 AS conv").repartition(6)
    want = hashlib.sha256(",".join(str(i - 7) for i in range(30_000)).encode()).hexdigest()
    assert [r["ends_sha256"] for r in trie.end_digests(ends).collect()] == [want]
