"""Exact dedup: SQL, odd rows, digests that collide, and runs that go on from a folder."""

import hashlib
from collections import defaultdict

import pytest

from tests.helpers import oracle_rows, rows_of
from tidemark.llm import exact

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
TURN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[(text or "").translate(TURN)].append((-1 if doc_id is None else doc_id, i, doc_id))
    out = []
    for text, members in groups.items():
        top = max(members)
        for m in members:
            out.append((m[2], top[2], len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return df.collect()


ODD = [(1, None), (2, ""), (3, " "), (4, "Straße ÄB"), (5, "straße Äb"), (6, "straße äb"), (7, "copy"), (7, "COPY"), (None, "copy"), (None, "alone"), (None, "alone"), (8, "long " * 200_000), (9, "LONG " * 200_000)]


def write(spark, rows, path, n=1):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sha string, level int").repartition(n).write.mode("append").parquet(str(path))


@pytest.mark.parametrize("digits", [64, 1])
def test_odd_rows_and_colliding_digests(spark, tmp_path, digits):
    rows = ODD + [(100 + i, f"text {i % 40}") for i in range(90)]
    write(spark, rows, tmp_path / "d", 3)
    found = got(exact.dedupe_stream(spark, str(tmp_path / "d"), digits=digits, files=1))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == plain(rows)
    stays = [r["text_sha256"] for r in found if r["kept"]]
    assert len(stays) == len(set(stays)) == len({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_later_runs_go_on(spark, tmp_path):
    first, second = [(i, f"t{i % 7}") for i in range(20)], [(50 + i, f"T{i % 9}") for i in range(20)]
    write(spark, first, tmp_path / "d", 2)
    folder = str(tmp_path / "state")
    assert len(got(exact.dedupe_stream(spark, str(tmp_path / "d"), folder=folder, digits=1))) == 20
    write(spark, second, tmp_path / "d", 2)
    found = got(exact.dedupe_stream(spark, str(tmp_path / "d"), folder=folder, digits=1))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == plain(first + second)
    seen = spark.read.schema(exact.SEEN).parquet(f"{folder}/seen")
    assert seen.groupBy("sha", "level").agg({"rep_row": "count"}).count() == seen.select("sha", "level", "rep_id", "rep_file", "rep_row").distinct().count()  # the first text of a key stays its first


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert got(exact.dedupe_stream(spark, str(tmp_path / "d"))) == []


def test_query_equals_sql(spark):
    expected, names = oracle_rows(exact.OP11_SQL, SF)
    assert names == COLUMNS
    assert rows_of([r.asDict() for r in exact.op11_exact(spark, SF).collect()], names) == rows_of(expected, names)
