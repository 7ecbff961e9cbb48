"""Near duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components, join_salted
from tidemark.llm.shared import broadcast_if_small, materialize, row_key, spread
from tidemark.llm.tokens import GOLD, coded_words, mix

#: Coordinates of a sketch and of a band: 40 bands of 5. A pair at similarity 0.8 shares no band with probability 1.2e-7.
COORDS, ROWS_PER_BAND = 200, 5
#: Least similarity in percent.
PERCENT = 80
#: Texts that are worked on at a time, and hashed elements per block of sketch rounds.
TEXTS, BLOCK = 512, 4096
#: Nodes on a side of a block of pairs, and parts of a family where it meets its sizes.
SIDE, SALT = 64, 32
PRIME = np.uint64(0x100000001B3)
DESCRIBED = "doc_id long, row_key long, n_shingles long, node binary, bands array<long>"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of `size` words.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    codes, offsets, hashes = coded_words(texts)
    words = hashes[codes]
    rolled = words.copy()
    for k in range(1, min(size, len(words))):  # all texts of a batch may have fewer words
        rolled[: len(rolled) - k] = mix(rolled[: len(rolled) - k] * PRIME + words[k:])
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), np.uint64)
        else:
            yield words[:0]


def sketch(items: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen, Thorup 2017) of a non-empty set of 64-bit hashes.

    In rounds 0 to t-1 every item falls into a hashed bin with value (round, hash); in round
    t + b all items go to bin b, so every bin is filled. A bin keeps its smallest value, hence
    later rounds never change a filled bin and the rounds stop when all are filled. Several
    rounds of a small set are done in one block.
    """
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    done, per_block = 0, max(1, BLOCK // len(items))
    while done < 2 * t:
        rounds = np.arange(done, min(done + per_block, 2 * t), dtype=np.uint64)
        h = mix(items[None, :] + (rounds[:, None] + np.uint64(1)) * GOLD)
        bins = np.where(rounds[:, None] < t, (h >> np.uint64(32)) % np.uint64(t), rounds[:, None] % np.uint64(t))
        np.minimum.at(out, bins.astype(np.int64).ravel(), ((rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        done += len(rounds)
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def band_keys(values: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    bands = values.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for k in range(rows):
        key = mix(key * PRIME + bands[:, k])
    return key.view(np.int64)


def node_of(items: np.ndarray) -> bytes:
    """128-bit name of a set: texts with one set are one node."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = list(shingle_sets(part.column(1), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([band_keys(sketch(s)) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "row_key", "n_shingles", "node", "bands"],
                )

    return run


def _verify(size: int, percent: int):
    """Pairs (a, b) of a block and the block's texts to the pairs whose full sets are similar enough."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = dict(zip(texts.column("node").to_pylist(), shingle_sets(texts.column("text").combine_chunks(), size)))
        ok = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = sets[a], sets[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def verified(pairs: DataFrame, held: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b, g, size) that are links, from texts in `held` (node, text).

    Pairs of one family g are dealt to blocks by a hash of each side, size / SIDE parts on each
    (size: the largest bucket in which a pair met), so that a text is sent once to a block and
    not once for each pair; a large family becomes many blocks.
    """
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("size") / SIDE))
    dealt = pairs.select("a", "b", F.xxhash64("g", F.ceil(F.col("size") / SIDE), part("a"), part("b")).alias("block"))
    sent = dealt.select(F.col("block").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = sent.join(held, "node").select("to", "node", "text")
    return dealt.groupBy("block").cogroup(texts.groupBy("to")).applyInArrow(_verify(size, percent), "a binary, b binary")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, n, size): the nodes in every band bucket that holds at least two."""
    rows = nodes.select(F.explode("bands").alias("key"), "node", F.col("n_shingles").alias("n"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes, "key")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Distinct (a, b, g, size): each bucket's members against its most central node g.

    A node's centrality is the sum of its buckets' sizes; the text that many copies come from
    has the largest, and is alike to all of them even where two copies aren't alike.
    """
    central = members.groupBy("node").agg(F.sum("size").alias("c"))
    leaders = members.select("key", "node", "n").join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node", "n")).alias("l"))
    sides = (F.col("l.node").alias("a"), F.col("l.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("l.node").alias("g"), "size")
    return _ordered(members.join(leaders, "key").select(*sides).filter(F.col("a") != F.col("b")).filter(_alike_sizes()))


def _alike_sizes():
    """Whether two sets' sizes allow the similarity."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with the smaller node first, and one family g."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("g").alias("g"), F.max("size").alias("size"))


def _verify_block(size: int, percent: int):
    """A block's outsiders (out) against its members: links among those that share a band but no component."""

    def run(rows: pa.Table) -> pa.Table:
        out = rows.column("out").combine_chunks()
        left, right = rows.filter(out), rows.filter(pc.invert(out))
        bands = [np.array(t.column("bands").to_pylist(), np.int64).reshape(t.num_rows, -1) for t in (left, right)]
        n = [t.column("n").to_numpy() for t in (left, right)]
        comp = [np.array(t.column("comp").to_pylist(), object) for t in (left, right)]
        sets = [list(shingle_sets(t.column("text").combine_chunks(), size)) if t.num_rows else [] for t in (left, right)]
        names = [t.column("node").to_pylist() for t in (left, right)]
        a, b = [], []
        for i, x in enumerate(sets[0]):
            fit = (bands[1] == bands[0][i]).any(axis=1) & (comp[1] != comp[0][i])
            fit &= np.minimum(n[1], n[0][i]) * 100 >= np.maximum(n[1], n[0][i]) * percent
            for j in np.flatnonzero(fit):
                common = len(np.intersect1d(x, sets[1][j], assume_unique=True))
                if 100 * common >= percent * (len(x) + len(sets[1][j]) - common):
                    a.append(names[0][i]), b.append(names[1][j])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def open_links(members: DataFrame, nodes: DataFrame, comps: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """Links (a, b) among all nodes that share a bucket but not a component.

    Every such pair has a side outside the bucket's largest component g. The nodes in buckets
    with one g are a family; its outsiders in parts of SIDE and all its nodes in parts of
    4 SIDE meet in blocks, one task's work each, which send every text a few times and give
    back links alone: no pair is ever a row.
    """
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("key", "node", "n", "comp")
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).filter("top.c < all")
    family = placed.join(largest.select("key", F.col("top.comp").alias("g")), "key").groupBy("g", "node").agg(F.min("n").alias("n"), F.min("comp").alias("comp"))
    family = materialize(family.withColumn("out", F.col("comp") != F.col("g")), "families")
    sizes = family.groupBy("g").agg(F.ceil(F.count_if("out") / SIDE).alias("so"), F.ceil(F.count(F.lit(1)) / (4 * SIDE)).alias("sm"))
    rows = join_salted(family, sizes, "g", "node", SALT)
    mine = lambda k: F.pmod(F.xxhash64("node"), F.col(k))
    spread = lambda out, own, other: rows.filter(out).select(
        "node", "n", "comp", F.lit(other == "sm").alias("out"), "g", mine(own).alias("_own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_other")
    )
    block = lambda o, m: F.xxhash64("g", o, m).alias("block")
    keep = ["node", "n", "comp", "out"]
    dealt = spread(F.col("out"), "so", "sm").select(*keep, block("_own", "_other")).union(spread(F.lit(True), "sm", "so").select(*keep, block("_other", "_own")))
    full = dealt.join(nodes.select("node", "bands"), "node").join(held, "node").select("block", *keep, "bands", "text")
    return full.groupBy("block").applyInArrow(_verify_block(size, PERCENT), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Texts with one shingle set are one node, so copies are never expanded. Nodes that share a
    band bucket are candidates; pairs are confirmed on the full sets of their whole texts. The
    first round tests each bucket's members against its most central node. After it, only pairs
    that share a bucket but no component are left; the second round tests all of these.

    component_id is the smallest doc_id of all texts reachable over links; kept is doc_id =
    component_id. Null text or text without words: no shingles, its own component. Repeated
    rows are copies of one another. A null doc_id is never the smallest unless all are null.
    Empty table: no rows.
    """
    return _grouped(docs, size, id_col, text_col).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, component_id, first.

    first holds for the rows of one (doc_id, node, row_key) of each component, its smallest with
    null ids last, and for every row without words. Such rows are copies of one another.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    described = materialize(texts.withColumn("row_key", row_key(F.col("doc_id").cast("long"), F.col("text"))).mapInArrow(_describe(size), DESCRIBED), "sketches")
    nodes = materialize(
        described.filter("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "row_key")).alias("least"), F.min(F.struct("n_shingles", "bands")).alias("x"))
        .select("node", "rep", "least", "x.*"), "nodes"
    )
    members = materialize(bucket_members(nodes), "members")
    pairs = materialize(leader_pairs(members), "pairs")
    comps = spark.createDataFrame([], "node binary, comp binary")
    if not pairs.isEmpty():
        # the texts of all nodes that can come up, read once
        held = materialize(_texts_of(texts, members.select("node").distinct().join(nodes.select("node", "rep"), "node"), size), "texts")
        links = materialize(verified(pairs, held, size), "links")
        comps = materialize(components(links), "comps")
        more = materialize(open_links(members, nodes, comps, held, size), "more-links")
        if not more.isEmpty():  # the stars so far and the new links have the same components as all links
            comps = materialize(components(more.union(comps)), "comps")
    linked = nodes.select("node", "least").join(comps, "node")
    ids = join_salted(linked.select("node", "comp"), linked.groupBy("comp").agg(F.min("least").alias("top")), "comp", "node", SALT).select("node", "top")
    ids = ids.union(nodes.select("node", "least").join(comps, "node", "left_anti"))
    mine = (F.col("node") == F.col("top.node")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("row_key") == F.col("top.row_key"))
    return described.select("doc_id", "row_key", "n_shingles", "node").join(ids, "node", "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("top.doc_id", "doc_id").alias("component_id"), (F.col("node").isNull() | mine).alias("first")
    )


def _texts_of(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, text) for the wanted (node, rep): one text whose set is the node's."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                same = [node_of(s) == n for s, n in zip(shingle_sets(part.column(1), size), part.column(0).to_pylist())]
                yield part.filter(pa.array(same, pa.bool_()))

    # an id may stand in several rows with different texts: keep the row that has the node's set
    rows = texts.join(broadcast_if_small(wanted), texts["doc_id"].eqNullSafe(wanted["rep"])).select("node", "text")
    return rows.mapInArrow(check, "node binary, text string").groupBy("node").agg(F.min("text").alias("text"))


def keep_one(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with the columns of `docs`.

    Rows are told apart by id and text: an id may stand in several rows with different texts,
    or be null, and each row goes or stays with its own group. A null id is kept only where its
    group has no other. Of equal rows one stays. Null texts and texts without words are nobody's
    copies and stay, one of each id. Empty table: no rows.
    """
    found = materialize(_grouped(docs, size, id_col, text_col), "groups")
    gone = found.filter(~F.col("first")).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    gone = broadcast_if_small(gone)
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (row_key(docs[id_col].cast("long"), docs[text_col]) == F.col("_key"))
    rest = docs.join(gone, same, "left_anti")
    twice = found.filter("first").groupBy("doc_id", "row_key").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    if not twice.count():
        return rest
    once = rest.join(twice, same, "left_anti")
    several = rest.join(twice, same, "left_semi")
    return once.union(several.dropDuplicates([id_col, text_col]))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
