"""Katz backoff bigram model with Good-Turing discounts, over all documents."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, spread
from tidemark.llm.tokens import coded_words, mix

#: Bytes of text in a chunk, and about how many entries one bucket of the tables gathers.
CHUNK_BYTES, BUCKET_ENTRIES, FILE_BYTES = 8_000_000, 1_500_000, 64_000_000
#: Counts above K aren't discounted.
K = 5
#: Hash of the end token, and id of the start mark, above all others.
END, BOS = np.uint64(0xE0D0E0D0E0D0E0D1), np.iinfo(np.int64).max
MASK = np.uint64(0xFFFFFFFF)
PART = "kind int, bucket int, chunk long, a binary, b binary, c binary, d binary"
PART_NAMES = ["kind", "bucket", "chunk", "a", "b", "c", "d"]


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """An array as zstd over its byte planes; a rising one as differences."""
    x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if rising else x)
    return x.dtype.char.encode() + zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpack(b: bytes, rising: bool = False) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    raw = np.frombuffer(zstandard.decompress(b[1:]), np.uint8)
    x = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def smoothed(n_r: dict[int, float], k: int = K) -> list[float]:
    """n[r] for r in 0..k + 1 on the line log n = a + b log r, fitted as in simple Good-Turing; empty without two points."""
    seen = [r for r in range(1, k + 2) if n_r.get(r, 0) > 0]
    if len(seen) < 2:
        return []
    # where counts between two seen ones are missing, n[r] stands for all of the gap
    wide = [(after - before) / 2 for before, after in zip([0, *seen], [*seen[1:], 2 * seen[-1] - seen[-2]])]
    b, a = np.polyfit(np.log(seen), np.log([n_r[r] / w for r, w in zip(seen, wide)]), 1)
    return [0.0, *(float(np.exp(a + b * np.log(r))) for r in range(1, k + 2))]


def ratios(n: list[float], k: int = K) -> list[float]:
    """Katz's Good-Turing ratios d[1..k] of the counts of counts n; empty if one isn't in (0, 1)."""
    if not n or not all(n[1:]) or (tail := (k + 1) * n[k + 1] / n[1]) >= 1:
        return []
    d = [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, k + 1)]
    return d if all(0 < x < 1 for x in d) else []


def discounts(n_r: dict[int, float], k: int = K) -> np.ndarray:
    """d[r] for r in 0..k: Good-Turing ratios of the counts of counts, or of the smoothed ones where these give none in (0, 1).

    The line gives ratios in (0, 1) whenever its slope is below -1; otherwise no Good-Turing
    estimate exists and the discounts are absolute, (r - D) / r.
    """
    n = [0.0, *(float(n_r.get(r, 0)) for r in range(1, k + 2))]
    absolute = min(0.95, max(0.05, n[1] / (n[1] + 2 * n[2]))) if n[1] and n[2] else 0.5
    d = ratios(n, k) or ratios(smoothed(n_r, k), k) or [(r - absolute) / r for r in range(1, k + 1)]
    return np.array([1.0, *d])


@dataclass(frozen=True)
class Unigrams:
    """The unigram level. counts: distinct training counts, descending; sizes: words with each;
    first: first id of each count's ids."""

    tokens: int
    types: int
    docs: int
    buckets: int
    counts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    d: np.ndarray = field(repr=False)

    @property
    def unknown(self) -> float:
        """Probability of the one unknown word: what the discounts leave."""
        return 1.0 - float((self.counts * self.d[np.where(self.counts <= K, self.counts, 0)] * self.sizes).sum()) / max(self.tokens, 1) if self.tokens else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        ratio = self.d[np.where(count <= K, count, 0)]
        return np.where(count > 0, ratio * count / max(self.tokens, 1), self.unknown)

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ids, side="right") - 1
        return np.where(ids == BOS, self.docs, self.counts[np.maximum(at, 0)] if len(self.counts) else 0)

    def salts(self, h: np.ndarray, buckets: int) -> np.ndarray:
        """Parts that a history's bigrams are dealt to: in proportion to its count, so no bucket gets a hot one whole."""
        return np.ceil(self.count_of(h) * buckets / max(self.tokens, 1)).astype(np.uint64)

    def bucket(self, h: np.ndarray, w: np.ndarray | None, buckets: int) -> np.ndarray:
        salt = mix(w.astype(np.uint64)) % np.maximum(self.salts(h, buckets), 1) if w is not None else np.uint64(0)
        return (mix(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(buckets)).astype(np.int64)


def held_out(doc_id) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
            ids, texts = batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at)
            codes, offsets, hashes = coded_words(texts)
            codes = np.insert(codes.astype(np.int32), offsets[1:], len(hashes))
            offsets = offsets + np.arange(len(offsets))
            held = [held_out(x) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | n], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([pack(offsets, True)]), pa.array([pack(codes)]), pa.array([pack(np.append(hashes, END))]), pa.array([len(hashes) + 1], pa.int64())],
                ["chunk", "ids", "held", "offsets", "codes", "hashes", "n_dict"],
            )
            at, n = upto, n + 1


CHUNKS = "chunk long, ids array<long>, held array<boolean>, offsets binary, codes binary, hashes binary, n_dict long"


PARTS = pa.schema([(n, k) for n, k in zip(PART_NAMES, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4))])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(PARTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTS)], schema=PARTS)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _train(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, is training token)."""
    codes, offsets = unpack(row["codes"]), unpack(row["offsets"], True)
    return codes, offsets, np.repeat(~np.array(row["held"], bool), np.diff(offsets))


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """The order by bucket, and from where to where each bucket that occurs stands in it."""
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return order, {int(k): (int(x), int(y)) for k, x, y in zip(found, begin, [*begin[1:], len(bucket)])}


def _word_requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            codes, _, train = _train(row)
            hashes = unpack(row["hashes"])
            count = np.bincount(codes[train], minlength=len(hashes)).astype(np.int64)
            order = np.argsort(hashes)
            hashes, count = hashes[order], count[order]
            # ranges of hashes, a power of two: the order by hash is the order by bucket
            _, at = _by_bucket((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32))
            yield _parts([(1, b, row["chunk"], pack(hashes[x:y], True), pack(count[x:y]), None, None) for b, (x, y) in at.items()])

    return run


def _word_group(table: pa.Table) -> pa.Table:
    """A bucket's requests to its table of counts (kind 0) and one answer per chunk (kind 1: counts, places among equal counts)."""
    rows = table.to_pylist()
    hashes, counts = [unpack(r["a"], True) for r in rows], [unpack(r["b"]) for r in rows]
    words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(words)).astype(np.int64)
    order = np.argsort(total, kind="stable")
    values, begin, size = np.unique(total[order], return_index=True, return_counts=True)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words)) - np.repeat(begin, size)
    out, at = [(0, rows[0]["bucket"], -1, pack(values), pack(size.astype(np.int64)), None, None)], 0
    for r, h in zip(rows, hashes):
        mine = inverse[at : at + len(h)]
        out.append((1, r["bucket"], r["chunk"], pack(total[mine]), pack(place[mine]), None, None))
        at += len(h)
    return pa.Table.from_batches([_parts(out)])


def _unigrams(words: DataFrame, docs: int, buckets: int) -> Unigrams:
    """Counts of counts on the driver: at most sqrt(2N) distinct counts for N tokens."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(row["a"])), pa.array(unpack(row["b"]))], ["r", "n"])

    found = words.filter("kind = 0").mapInArrow(classes, "r long, n long").filter("r > 0").groupBy("r").agg(F.sum("n"), F.max("n")).collect()
    found.sort(reverse=True)
    counts, sizes, most = (np.array([x[i] for x in found], np.int64) for i in range(3))
    room = most * buckets  # ids leave gaps: 64 bits hold them for any corpus
    first = np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    return Unigrams(
        int((counts * sizes).sum()), int(sizes.sum()), docs, buckets, counts, sizes, first, discounts({int(r): int(n) for r, n in zip(counts, sizes) if r <= K + 1})
    )


def _ids(row: dict, uni: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Per code of the chunk: training count, and id (-1 where unseen)."""
    hashes = unpack(row["hashes"])
    answers = sorted(row["words"], key=lambda x: x["bucket"])
    count = np.concatenate([unpack(x["a"]) for x in answers])
    place = np.concatenate([unpack(x["b"]) for x in answers])
    bucket = np.repeat([x["bucket"] for x in answers], [len(unpack(x["a"])) for x in answers])
    at = np.searchsorted(-uni.counts, -count)
    ids = np.where(count > 0, np.append(uni.first, 0)[at] + place * uni.buckets + bucket, -1)
    out_count, out_ids = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
    order = np.argsort(hashes)
    out_count[order], out_ids[order] = count, ids
    return out_count, out_ids


@dataclass(frozen=True)
class Asked:
    """What a chunk asks of the bigram tables.

    ids: its distinct ids, rising, the start mark last; h, w: per token the ranks of history and
    word in them (-1: unseen); both: tokens with neither unseen; pair: their place among the
    distinct bigrams (ph, pw, by rank); order, at: the bigrams by bucket; hist, hist_at: its
    histories' ranks by bucket, without those that are dealt to several.
    """

    ids: np.ndarray
    h: np.ndarray
    w: np.ndarray
    both: np.ndarray
    pair: np.ndarray
    ph: np.ndarray
    pw: np.ndarray
    order: np.ndarray
    at: dict[int, tuple[int, int]]
    hist: np.ndarray
    hist_at: dict[int, tuple[int, int]]


def _ask(codes: np.ndarray, offsets: np.ndarray, of_code: np.ndarray, uni: Unigrams, buckets: int) -> Asked:
    ids = np.append(np.unique(of_code[of_code >= 0]), BOS)
    w = np.where(of_code >= 0, np.searchsorted(ids, of_code), -1).astype(np.int32)[codes]
    h = np.append(w[:1], w[:-1])
    h[offsets[:-1]] = len(ids) - 1
    both = (h >= 0) & (w >= 0)
    distinct, pair = np.unique((h[both].astype(np.uint64) << np.uint64(32)) | w[both].astype(np.uint64), return_inverse=True)
    pair, ph, pw = pair.astype(np.int32), (distinct >> np.uint64(32)).astype(np.int32), (distinct & MASK).astype(np.int32)
    order, at = _by_bucket(uni.bucket(ids[ph], ids[pw], buckets))
    hist = np.flatnonzero(np.bincount(h[h >= 0], minlength=len(ids)))
    hist = hist[uni.salts(ids[hist], buckets) <= 1]
    h_order, hist_at = _by_bucket(uni.bucket(ids[hist], None, buckets))
    return Asked(ids, h, w, both, pair, ph, pw, order, at, hist[h_order], hist_at)


def _pair_requests(uni: Unigrams, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            codes, offsets, train = _train(row)
            q = _ask(codes, offsets, _ids(row, uni)[1], uni, buckets)
            count = np.bincount(q.pair, weights=train[q.both], minlength=len(q.ph)).astype(np.int64)[q.order]
            h, w, hist = q.ids[q.ph[q.order]], q.ids[q.pw[q.order]], q.ids[q.hist]
            rows = []
            for b in q.at.keys() | q.hist_at.keys():
                (x, y), (i, j) = q.at.get(b, (0, 0)), q.hist_at.get(b, (0, 0))
                rows.append((1, b, row["chunk"], pack(h[x:y], True), pack(w[x:y]), pack(count[x:y]), pack(hist[i:j], True)))
            yield _parts(rows)

    return run


def _pair_group(table: pa.Table) -> pa.Table:
    """A bucket's requests to the stored bigrams (kind 0, with counts of counts) and where each chunk's entries stand (kind 1)."""
    rows = table.to_pylist()
    asked = [(unpack(r["a"], True), unpack(r["b"]), unpack(r["c"]), unpack(r["d"], True)) for r in rows]
    (hs, h), (ws, w) = (np.unique(np.concatenate([x[i] for x in asked]), return_inverse=True) for i in (0, 1))
    distinct, inverse = np.unique((h.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([x[2] for x in asked]), minlength=len(distinct)).astype(np.int64)
    stored = total > 0
    number = np.cumsum(stored) - 1
    h, w, total = hs[(distinct[stored] >> np.uint64(32)).astype(np.int64)], ws[(distinct[stored] & MASK).astype(np.int64)], total[stored]
    hist = np.unique(h)
    n_r = np.bincount(np.minimum(total, K + 2), minlength=K + 3).astype(np.int64)
    out, at = [(0, rows[0]["bucket"], -1, pack(h, True), pack(w), pack(total), pack(n_r))], 0
    for r, (mine_h, _, _, histories) in zip(rows, asked):
        mine = inverse[at : at + len(mine_h)]
        at += len(mine_h)
        here, has = np.flatnonzero(stored[mine]), np.flatnonzero(np.isin(histories, hist))
        if len(here) or len(has):
            out.append((1, r["bucket"], r["chunk"], pack(here, True), pack(number[mine[here]], True), pack(has, True), pack(np.searchsorted(hist, histories[has]), True)))
    return pa.Table.from_batches([_parts(out)])


def _sums(row: dict, uni: Unigrams, d: np.ndarray):
    """Of a bucket's stored bigrams: (histories, begin, p of each bigram, its word's unigram p, sums of both per history)."""
    h, w, counts = unpack(row["a"], True), unpack(row["b"]), unpack(row["c"])
    hist, begin = np.unique(h, return_index=True)
    p = d[np.where(counts <= K, counts, 0)] * counts / uni.count_of(h)
    p1 = uni.p(uni.count_of(w))
    return hist, begin, p, p1, np.add.reduceat(p, begin), np.add.reduceat(p1, begin)


def backoff(s2: np.ndarray, s1: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, alpha): the weight that makes a history's probabilities sum to one exactly.

    A history whose bigrams use up all mass keeps 1 / (count + 1) of it for unseen words: its
    bigrams are scaled down by `scale`.
    """
    scale = np.where(1 - s2 < 1 / (count + 1), (count / (count + 1)) / s2, 1.0)
    return scale, (1 - scale * s2) / (1 - s1)


def _score_group(uni: Unigrams, d: np.ndarray, hot: dict[int, tuple[float, float]]):
    """Stored bigrams and places of a bucket to what each chunk adds: log10 ratios of bigrams, log10 alpha of histories."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        out = []
        if len(unpack(own["c"])):
            hist, begin, p, p1, s2, s1 = _sums(own, uni, d)
            for i in np.flatnonzero(np.isin(hist, list(hot))):
                s2[i], s1[i] = hot[int(hist[i])]
            scale, alpha = backoff(s2, s1, uni.count_of(hist))
            each = np.repeat(np.arange(len(hist)), np.diff(np.append(begin, len(p))))
            gain = (np.log10(p * scale[each]) - np.log10(alpha[each]) - np.log10(p1)).astype(np.float32)
            weight = np.log10(alpha).astype(np.float32)
            out = [
                (1, r["bucket"], r["chunk"], r["a"], pack(gain[unpack(r["b"], True)]), r["c"], pack(weight[unpack(r["d"], True)]))
                for r in rows if r["kind"] == 1
            ]
        return pa.Table.from_batches([_parts(out)])

    return run


def _score(uni: Unigrams, buckets: int, hot_alpha: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            codes, offsets, _ = _train(row)
            count, of_code = _ids(row, uni)
            q = _ask(codes, offsets, of_code, uni, buckets)
            gain, weight = np.zeros(len(q.ph)), np.zeros(len(q.ids))
            for x in row["pairs"] or ():
                gain[q.order[q.at.get(x["bucket"], (0, 0))[0] + unpack(x["a"], True)]] = unpack(x["b"])
                weight[q.hist[q.hist_at.get(x["bucket"], (0, 0))[0] + unpack(x["c"], True)]] = unpack(x["d"])
            for k, a in hot_alpha.items():
                at = np.searchsorted(q.ids, k)
                if at < len(q.ids) and q.ids[at] == k:
                    weight[at] = math.log10(a)
            total = np.log10(uni.p(count))[codes]
            total[q.both] += gain[q.pair]
            total += np.where(q.h >= 0, weight[q.h], 0.0)
            base = np.log10((count + 1) / (uni.tokens + uni.types + 1))[codes]
            begin = offsets[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.diff(offsets)),
                 pa.array(np.add.reduceat((count > 0)[codes].astype(np.int64), begin)), pa.array(np.full(len(begin), uni.tokens, np.int64)),
                 pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(total, begin))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _power(entries: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(entries, 1) / BUCKET_ENTRIES)))


def _answers(parts: DataFrame, name: str) -> DataFrame:
    return parts.filter("kind = 1").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "a", "b", "c", "d")).alias(name))


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is its lower-cased words and one end token; its first word follows a start mark.
    P(w|h) is the discounted ratio of counts for bigrams seen in training, else alpha(h) P(w); P(w) is discounted in the same way, with what is left for the one unknown
    word. score = sum over tokens of log10 P(w) + log10 alpha(h) + [log10 P(w|h) - log10 alpha(h)
    - log10 P(w) if the bigram is stored]: the recursion, one lookup per level.

    The texts become chunks, written once as a table bucketed by chunk. Words and bigrams are
    counted and looked up in tables partitioned by hash; a chunk asks for each of its distinct
    entries once and gets answers in the order it asked, so no row stands for a single token.
    A history with more than its share of tokens is dealt to several buckets.

    Null text: the end token alone. Null ids are never held out. Repeated rows each count and
    each get a row. Empty table: no rows. Without training documents every word is unknown.
    """
    spark = docs.sparkSession
    slim = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    weight = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), weight // FILE_BYTES)
    name = f"tidemark_chunks_{uuid.uuid4().hex}"
    try:
        slim.mapInArrow(_chunks, CHUNKS).write.option("compression", "zstd").bucketBy(files, "chunk").format("parquet").saveAsTable(name)
        return _scores(spark.table(name), weight)
    finally:  # the scores are written by then
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scores(chunks: DataFrame, weight: int) -> DataFrame:
    spark = chunks.sparkSession
    n_docs, n_words, n_tokens = chunks.agg(
        F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum("n_dict"), F.sum(F.octet_length("codes"))
    ).first()
    if n_words is None:
        return spark.createDataFrame([], SCORES)
    word_buckets = _power(n_words)
    grouped: Callable[[DataFrame, Callable], DataFrame] = lambda df, f: df.groupBy("bucket").applyInArrow(f, PART)
    words = materialize(grouped(chunks.select("chunk", "held", "offsets", "codes", "hashes").mapInArrow(_word_requests(word_buckets), PART), _word_group), "words")
    uni = _unigrams(words, n_docs, word_buckets)
    buckets = _power(weight // 6)
    known = chunks.join(_answers(words, "words"), "chunk")
    pairs = materialize(grouped(known.mapInArrow(_pair_requests(uni, buckets), PART), _pair_group), "pairs")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(K + 3)), pa.array(unpack(row["d"]))], ["r", "n"])

    n_r = dict(pairs.filter("kind = 0").mapInArrow(totals, "r long, n long").groupBy("r").agg(F.sum("n")).collect())
    d = discounts({r: n for r, n in n_r.items() if 1 <= r <= K + 1})

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            if len(unpack(row["c"])):
                hist, _, _, _, s2, s1 = _sums(row, uni, d)
                split = uni.salts(hist, buckets) > 1
                yield pa.RecordBatch.from_arrays([pa.array(hist[split]), pa.array(s2[split]), pa.array(s1[split])], ["h", "s2", "s1"])

    # histories over one bucket's share of the tokens: fewer than there are buckets
    hot = {h: (s2, s1) for h, s2, s1 in pairs.filter("kind = 0").mapInArrow(hot_sums, "h long, s2 double, s1 double").groupBy("h").agg(F.sum("s2"), F.sum("s1")).collect()}
    alpha = {h: float(backoff(np.array([s2]), np.array([s1]), uni.count_of(np.array([h])))[1][0]) for h, (s2, s1) in hot.items()}
    gains = grouped(pairs, _score_group(uni, d, hot))
    return materialize(known.join(_answers(gains, "pairs"), "chunk", "left").mapInArrow(_score(uni, buckets, alpha), SCORES), "scores")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
