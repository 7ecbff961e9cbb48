"""Prefix trie of conversations: nodes by digest, minimal perfect hash tables per shard, sums through parent slots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import broadcast_if_small, materialize
from tidemark.llm.tokens import GOLD, mix

# Fixed values of the rebuilding: conversations of a family, and the head lengths 0 to 8.
FAMILY, HEADS = 5, 9
#: A node with more turns of its members at or below it than this lies above the shards.
HEAVY = 2_000
#: Shards at least, and nodes for which another one is added.
SHARDS, SHARD_NODES = 64, 16_000
NODE = ["depth", "a", "b"]


def head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEADS))


def _with_offsets(parts: DataFrame, part_total: Column, total: str, add) -> DataFrame:
    """`parts` with `_before`: `add` of the totals of the same conversation's earlier range partitions.

    Only conversations that lie in several partitions have any: two rows a partition at most.
    """
    sums = parts.groupBy("_part", "conv").agg(part_total.alias(total))
    ahead = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.withColumns({"_before": add(total).over(ahead), "_n": F.count(F.lit(1)).over(Window.partitionBy("conv"))}).filter("_n > 1")
    return parts.join(F.broadcast(spans.select("_part", "conv", "_before")), ["_part", "conv"], "left")


def _ranked(rows: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """Write `rows` in ranges of (conv, order) and number each conversation's rows from 1, over partitions too."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    parts = materialize(tied.repartitionByRange("conv", *[F.col(c).asc_nulls_first() for c in order], "_tie").withColumn("_part", F.spark_partition_id()), name)
    inside = Window.partitionBy("_part", "conv").orderBy(*[F.col(c).asc_nulls_first() for c in order], "_tie")
    placed = _with_offsets(parts, F.count(F.lit(1)), "_rows", F.sum).withColumn(out, F.row_number().over(inside) + F.coalesce("_before", F.lit(0)))
    return placed.drop("_tie", "_before")


def rebuilt_prefixes(df: DataFrame, width: int = 64, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(ids, prefixes): every conversation id; per rebuilt turn its prefix (conv, depth, digest a/b, parent's digest pa/pb, sha, bytes, left).

    A digest is the XOR of hashes of (place, turn), two lanes of `width` bits, so prefixes are
    running XORs and a conversation's turns may lie in several tasks. `left` counts turns from here on.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = df.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).filter("conv IS NOT NULL")
    turns = _ranked(rows, ["turn", "role", "text"], "pos", "turns").select(
        "conv", "pos", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes")
    )
    turns = materialize(turns, "places")
    ids = materialize(turns.select("conv").distinct(), "ids")
    family = F.array(*[F.col("conv") + k for k in range(1 - FAMILY, FAMILY)])
    heads = turns.filter((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumn("to", F.explode(family))
    heads = heads.filter((F.col("to") - F.col("to") % FAMILY == F.col("conv")) & (F.col("pos") <= head_length(F.col("to"))))
    heads = heads.select(F.col("to").alias("conv"), F.lit(0).alias("own"), "pos", "sha", "bytes").join(ids, "conv", "left_semi")
    own = turns.filter(F.col("pos") > head_length(F.col("conv"))).select("conv", F.lit(1).alias("own"), "pos", "sha", "bytes")
    placed = _ranked(heads.unionByName(own), ["own", "pos"], "depth", "rebuilt")
    lane = lambda k: F.xxhash64(F.lit(seed * 2 + k), "depth", "sha").bitwiseAND(F.lit(-1 if width == 64 else 2**width - 1).cast("bigint"))
    hashed = materialize(placed.select("conv", "_part", "depth", lane(0).alias("x"), lane(1).alias("y"), "sha", "bytes"), "hashed")
    inside = Window.partitionBy("_part", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for x, out in (("x", "a"), ("y", "b")):
        hashed = _with_offsets(hashed, F.bit_xor(x), "_xor", F.bit_xor)
        hashed = hashed.withColumn(out, F.bit_xor(x).over(inside).bitwiseXOR(F.coalesce("_before", F.lit(0).cast("bigint")))).drop("_before")
    length = hashed.groupBy("conv").agg(F.max("depth").alias("_len"))
    ended = hashed.join(length, "conv").withColumn("left", F.col("_len") - F.col("depth") + 1)
    prefixes = ended.select("conv", F.col("depth").cast("bigint").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "sha", "bytes", F.col("left").cast("bigint").alias("left"))
    return ids, materialize(prefixes, "prefixes")


def distinct_nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """(nodes, sound): one row per digest and depth, summed before the shuffle; sound if each has one parent and one last turn.

    By induction over depth, equal digests then mean equal sequences of turns.
    """
    last = F.struct("pa", "pb", "sha")
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("left").alias("size"), F.max("bytes").alias("bytes"), F.min(last).alias("lo"), F.max(last).alias("hi")
    )
    nodes = materialize(nodes.select(*NODE, "conv_id", "n_convs", "size", "bytes", F.col("lo.pa").alias("pa"), F.col("lo.pb").alias("pb"), (F.col("lo") == F.col("hi")).alias("one")), "nodes")
    return nodes, nodes.filter("NOT one").isEmpty()


class MinimalHash:
    """Slots 0 to n-1 for n distinct 64-bit keys: rounds of hashing, in which a place that one key alone meets is its own."""

    def __init__(self, keys: np.ndarray) -> None:
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        base, left = 0, keys
        while len(left):
            at = self._place(left, len(self.rounds), 2 * len(left) + 1)
            own = np.bincount(at, minlength=2 * len(left) + 1) == 1
            self.rounds.append((own, base + np.cumsum(own) - 1))
            base, left = base + int(own.sum()), left[~own[at]]
            if len(self.rounds) > 200:
                raise ValueError("keys are not distinct")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * int(GOLD) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A key's slot; any slot or -1 for a key that isn't in the table, so callers compare what lies there."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (own, rank) in enumerate(self.rounds):
            at = self._place(keys[rest], level, len(own))
            hit = own[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


def _folded(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of a node; equal ones of different nodes are told apart by salt in _table."""
    return mix(a.view(np.uint64) ^ mix(b.view(np.uint64) + depth.view(np.uint64) * GOLD))


def _table(nodes: pa.Table) -> pa.Table:
    """A shard's nodes with parent_conv_id (null: the parent lies above), n_children, n_leaves and saved_tokens."""
    get = lambda c: np.ascontiguousarray(nodes.column(c).to_numpy())
    depth, a, b = get("depth"), get("a"), get("b")
    keys, salt = _folded(depth, a, b), np.uint64(0)
    while len(np.unique(keys)) < len(keys):  # two nodes with one key: another key for all
        salt += np.uint64(1)
        keys = _folded(depth, a ^ salt.view(np.int64), b)
    table = MinimalHash(keys)
    slot, n = table.slots(keys), len(keys)
    scattered = np.empty((6, n), np.int64)
    scattered[:, slot] = depth, a, b, get("conv_id"), get("n_convs"), get("bytes")
    depth, a, b, conv, members, size = scattered
    above = np.empty((2, n), np.int64)
    above[:, slot] = get("pa"), get("pb")
    parent = table.slots(_folded(depth - 1, above[0] ^ salt.view(np.int64), above[1]))
    same = (parent >= 0) & (depth[parent] == depth - 1) & (a[parent] == above[0]) & (b[parent] == above[1])
    parent[~same] = -1
    children = np.bincount(parent[same], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * size
    order = np.argsort(depth, kind="stable")
    bounds = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, bounds)[::-1]:  # the deepest first
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    from_above = pa.array(np.where(same, conv[parent], 0), pa.int64(), mask=~same)
    return pa.table([depth, a, b, above[0], above[1], conv, from_above, members, children.astype(np.int64), leaves, saved], names=[c for c, _ in SHARD])


SHARD = [(c, "bigint") for c in (*NODE, "pa", "pb", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]


def _above(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes above the shards, summed by doubling: after round k a node has what lies under 2^k steps below it.

    `tops` are the shards' topmost nodes. Rounds are log2 of the depth of what lies above, few nodes as a rule.
    """
    up = [F.col("depth") - 1, F.col("pa"), F.col("pb")]
    light = tops.groupBy(*[c.alias(n) for c, n in zip(up, NODE)]).agg(F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
    inner = heavy.filter("depth > 0").groupBy(*[c.alias(n) for c, n in zip(up, NODE)]).agg(F.count(F.lit(1)).alias("_h"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    cur = heavy.join(light, NODE, "left").join(inner, NODE, "left").withColumn("n_children", zero("_c") + zero("_h"))
    cur = cur.select(
        *NODE, "pa", "pb", "conv_id", "n_convs", "n_children", (zero("_l") + (F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
        (zero("_s") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.when(F.col("depth") > 0, F.struct(*[c.alias(n) for c, n in zip(up, NODE)])).alias("to"),
    )
    cur = materialize(cur.withColumn("node", F.struct(*NODE)), "above")
    while not cur.filter("to IS NOT NULL").isEmpty():
        given = cur.filter("to IS NOT NULL").groupBy(F.col("to").alias("node")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        further = cur.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        cur = cur.join(given, "node", "left").join(broadcast_if_small(further), "to", "left").withColumns({"n_leaves": F.col("n_leaves") + zero("_l"), "saved_tokens": F.col("saved_tokens") + zero("_s"), "to": F.col("_to")})
        cur = materialize(cur.drop("_l", "_s", "_to"), "above")
    return cur.drop("to", "node")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to one row per node and batch: the ids as comma-joined text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        starts = np.concatenate([[0], np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)) + 1])
        ids = [str(c) for c in cols[3].tolist()]
        texts = [",".join(ids[i:j]) for i, j in zip(starts, [*starts[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in cols), pa.array(texts, pa.string())], names=[*NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one SHA-256 per node; a node's chunks pass through one after the other."""
    node, sha = None, None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == node:
                sha.update(b"," + ids.encode())
            else:
                done += [(*node, sha.hexdigest())] if node else []
                node, sha = key, hashlib.sha256(ids.encode())
        if done:
            yield _digest_rows(done)
    if node:
        yield _digest_rows([(*node, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.string(),))], names=[*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv): ids in numeric order, joined to chunks in ranges before they meet by node."""
    chunks = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(_chunks, "depth bigint, a bigint, b bigint, first bigint, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth bigint, a bigint, b bigint, ends_sha256 string")


def conversation_trie(df: DataFrame, heavy: int = HEAVY, width: int = 64) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Nodes are distinct prefix digests, checked for collisions (else all is hashed anew). Nodes
    with at most `heavy` turns of members at or below them form whole subtrees, which are dealt
    to shards by their topmost node; a shard is a minimal perfect hash table over flat arrays.
    What lies above is summed by doubling.

    Null role and text are empty. Turns with equal `turn` are ordered by role and text; repeated
    rows are turns of their own. Rows without conv_id belong to no conversation. Empty table: no
    rows, the root included. Other columns are ignored.
    """
    for seed in range(4):
        ids, prefixes = rebuilt_prefixes(df, width if seed == 0 else 64, seed)
        nodes, sound = distinct_nodes(prefixes)
        if sound:
            break
    else:
        raise ValueError("digests collide under every seed")
    top = nodes.filter(F.col("size") > heavy)
    depths = prefixes.join(broadcast_if_small(top.select(*NODE)), NODE, "left_semi").groupBy("conv").agg(F.max("depth").alias("_k"))
    roots = prefixes.join(depths, "conv", "left").filter(F.col("depth") == F.coalesce("_k", F.lit(0)) + 1).select(F.col("conv").alias("conv_id"), F.xxhash64("depth", "a", "b").alias("_root"))
    shards = max(SHARDS, -(-nodes.count() // SHARD_NODES))
    below = nodes.filter(F.col("size") <= heavy).join(roots, "conv_id").withColumn("_shard", F.pmod("_root", F.lit(shards)))
    done = materialize(below.drop("_root").groupBy("_shard").applyInArrow(_table, ", ".join(f"{c} {k}" for c, k in SHARD)), "shards")
    tops = done.filter("parent_conv_id IS NULL")
    none = lambda v: F.lit(v).cast("bigint")
    root = ids.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[none(0).alias(c) for c in NODE], none(None).alias("pa"), none(None).alias("pb"), "conv_id", "n_convs", none(0).alias("bytes"))
    upper = materialize(_above(top.select(*root.columns).unionByName(root), tops), "upper")
    parents = broadcast_if_small(upper.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")))
    hanging = upper.unionByName(tops.drop("parent_conv_id")).join(parents, ["depth", "pa", "pb"], "left")
    whole = hanging.unionByName(done.filter("parent_conv_id IS NOT NULL"))
    turnless = ids.join(prefixes.filter("depth = 1").select("conv"), "conv", "left_anti").select(*[none(0).alias(c) for c in NODE], "conv")
    ends = end_digests(prefixes.filter("left = 1").select(*NODE, "conv").unionByName(turnless))
    return whole.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM c, tab),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, 0 AS g, pos, role, txt FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND pos <= h
      UNION ALL SELECT conv_id, 1, pos, role, txt FROM h JOIN t USING (conv_id) WHERE pos > h),
s AS (SELECT conv_id, list(strlen(role)::VARCHAR || ':' || role || txt ORDER BY g, pos) AS path, list(strlen(txt) ORDER BY g, pos) AS sizes FROM r GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(path, []) AS path, coalesce(sizes, []) AS sizes FROM c LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, d, path[:d] AS pre, len(path) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS bytes FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM f)),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, pre),
k AS (SELECT pre[:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (pre)),
u AS (SELECT pre[:e] AS pre, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u USING (pre) LEFT JOIN n q ON v.d > 0 AND q.pre = v.pre[:v.d - 1]
"""
