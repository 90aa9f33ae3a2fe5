"""Every query with SQL gives DuckDB's rows; the others are held against brute force."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators import retrieval
from lodestone.plans import catalogue
from lodestone.sources import TABLES
from lodestone.streaming import windows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else str(v) if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_simhash_bit_by_bit(spark):
    got = {r["doc_id"]: r["simhash"] for r in catalogue.queries()["simhash64"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect():
        x = re.sub(r"\s+", "", r["text"][:8000])
        votes = np.zeros(64, int)
        for g in {x[i : i + 3] for i in range(len(x) - 2)} or {x}:
            h = int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big")
            votes += np.array([1 if h >> i & 1 else -1 for i in range(64)])
        want = sum(1 << i for i in range(64) if votes[i] > 0)
        assert got[r["doc_id"]] % (1 << 64) == want


def test_near_duplicates_are_all_found(spark):
    h = {r["doc_id"]: r["simhash"] % (1 << 64) for r in catalogue.queries()["simhash64"](spark, DATA).collect()}
    first = {}
    for d in sorted(h):
        first.setdefault(h[d], d)
    ids = sorted(first.values())
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(h[a] ^ h[b]).count("1") <= 6}
    assert {(r["a"], r["b"]) for r in catalogue.queries()["near_dup_pairs"](spark, DATA).collect()} == want


def test_components_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 4)], "a long, b long")
    assert {tuple(r) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (5, 6)], "a long, b long")
    assert {r["node"] for r in graph.cycles(p).collect()} == {2, 3}


def test_stream_equals_table(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = windows.window_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in windows.window_counts(e).collect()}
    assert {tuple(r) for r in spark.sql("SELECT event_type, start, n FROM counts").collect()} == want


def test_ingest_by_both_keys(spark):
    b = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u1", "h3"), (4, "u4", "h0")], "id long, url string, text_hash string")
    known = spark.createDataFrame([(0, "u0", "h0")], "id long, url string, text_hash string")
    assert {r["id"] for r in windows.ingest_new(b, known).collect()} == {1}


def test_mmr_against_a_plain_loop(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [("s", i, "c" if i % 3 else f"d{i}", 100 - i, " ".join(words[(i // 4 + k) % 8] for k in range(6)) + (f" {i}" if i % 2 else "")) for i in range(24)]
    rows += [("t", 50 + i, "one", 9, "same text here") for i in range(7)] + [("u", 90, "x", 1, "ab")]

    def tri(x):
        x = x.replace(" ", "")
        return {x[i : i + 3] for i in range(len(x) - 2)} or {x}

    want = set()
    for seed in "stu":
        own, chosen = sorted((r for r in rows if r[0] == seed), key=lambda r: (-r[3], r[1])), []
        for r in own:
            same = any(len(tri(r[4]) & tri(x[4])) / len(tri(r[4]) | tri(x[4])) > 0.72 for x in chosen)
            if len(chosen) < 8 and sum(x[2] == r[2] for x in chosen) < 3 and (not same or len(chosen) >= 6):
                chosen.append(r)
        if len(chosen) < 6:
            chosen = sorted({*chosen, *own[:8]}, key=own.index)[:8]
        want |= {(seed, n, r[1]) for n, r in enumerate(chosen)}
    got = retrieval.mmr(spark.createDataFrame(rows, "seed string, id long, cluster string, score int, text string"))
    assert {tuple(r) for r in got.collect()} == want
    assert catalogue.queries()["mmr_select"](spark, DATA).count() > 8
