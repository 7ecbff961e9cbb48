"""Every stage against a plain version of it, on odd rows, copies and a table of documents."""

from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import pytest

import corpus_pipeline
from tests.llm.test_operators import _found
from tidemark.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
KEY = ("doc_id", "text", "source")


def _toxic(text, lexicon):
    """Looks at every word with every term."""
    words, weight, spared = toxicity.fold(text or "").split(), 0.0, set()
    for phrase in lexicon.exceptions:
        p = toxicity.fold(phrase).split()
        spared |= {i + k for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p))}
    for i, w in enumerate(words):
        found = [x for term, stem, x in lexicon.terms if (w.startswith(term) if stem else w == term)]
        weight += max(found) if found and i not in spared else 0.0
    a, b = toxicity.features(weight, len(words))
    return lexicon.bias + lexicon.slopes[0] * a + lexicon.slopes[1] * b >= 0


def _one_of_each(rows):
    """All pairs of five-word sets, union-find, one row a group by (id, null last)."""
    sets = []
    for _, text, _ in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in (text or "").split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for j in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[j[0]] & sets[j[1]])
        if 100 * both >= 80 * (len(sets[j[0]]) + len(sets[j[1]]) - both):
            a, b = map(find, j)
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[("row", r[0], r[1]) if not sets[i] else find(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _mixed(rows):
    size = lambda r: len((r[1] or "").split())
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, list(order), float(sum(sizes.values()))
    while True:
        level = rest / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    out = []
    for r in rows:
        rate = min(3.0, target[r[2]] / sizes[r[2]]) if sizes[r[2]] else 0.0
        key = "|".join((mixing.SEED, "" if r[0] is None else str(r[0]), md5((r[1] or "").encode()).hexdigest()))
        out += [r] * (int(rate) + (int(md5(key.encode()).hexdigest()[:12], 16) / 2**48 < rate - int(rate)))
    return out


def _sharded(rows):
    sized = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1, crc32((r[1] or "").encode())) for r in rows)
    total, before, out = sum(x[2] for x in sized), 0, []
    for there, i, n, c in sized:
        out.append((i if there else None, n, c, min(15, (2 * before + n) * 16 // (2 * total))))
        before += n
    return out


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(140)
    more = [(i, t, "en", s, 0) for i, t, s in (
        (None, None, None), (9001, "", "a"), (9002, "one two", None), (None, "one two", "b"), (9003, " ".join(f"w{k}" for k in range(40)), "c"),
        (9003, " ".join(f"w{k}" for k in range(40)), "c"), (None, " ".join(f"w{k}" for k in range(40)), "c"), (9003, "another text of this id with enough words", None), (9004, " \n ", "a"),
    )]
    extra = spark.createDataFrame(more, real.schema)
    return real.union(extra).union(real.limit(5))


def _rows(df):
    return Counter(tuple(r[c] for c in KEY) for r in df.collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]


def test_every_stage_equals_its_plain_version(spark, docs):
    stages, rows = dict(corpus_pipeline.STAGES), list(_rows(docs).elements())
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert _rows(stages["toxicity"](spark, docs, SF)) == Counter(r for r in rows if not _toxic(r[1], lexicon))
    assert stages["toxicity"](spark, docs, SF).columns == docs.columns
    one = stages["near duplicates"](spark, docs, SF)
    got, want = _rows(one), _one_of_each(rows)
    assert one.columns == docs.columns and Counter((i, t) for i, t, _ in got.elements()) == Counter((i, t) for i, t, _ in want)
    clean = stages["decontamination"](spark, docs, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _rows(clean) == Counter(r for r in rows if not any(_found(r[1] or "", x) for x in items)) and clean.columns == docs.columns
    mixed = stages["mixing"](spark, docs, SF)
    assert _rows(mixed) == Counter(_mixed(rows)) and mixed.columns == docs.columns
    placed = stages["sharding"](spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in placed) == Counter(_sharded(rows))


def test_stages_take_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0, name


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).filter("shard BETWEEN 0 AND 15").count() > 0
