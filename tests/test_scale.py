"""Shapes of plans and steps whose work must not outgrow the tables."""

import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import arrivals, graph, retrieval
from lodestone.operators import resolution as R
from lodestone.plans import bundles, catalogue, stores, texts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_by_block_keys_are_not_broadcast(spark):
    rows = spark.range(200).select(F.col("id").alias("at"), F.xxhash64("id").alias("simhash"))
    assert "Broadcast" not in plan(arrivals.met(rows, rows))


def test_pieces_are_no_rows(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, "ab"), (3, ""), (4, None), (5, "a b　c𠀀d"), (5, "xyz"), (None, "abcd")], "id long, text string")
    out = arrivals.simhashes(docs)
    got = {r["id"]: r["simhash"] for r in out.collect()}
    piece = {p: spark.range(1).select(F.conv(F.substring(F.md5(F.lit(p)), 1, 16), 16, -10).cast("long")).first()[0] for p in ("abc", "bcd", "ab", "bc𠀀", "c𠀀d", "xyz")}

    def votes(*pieces):
        h = [piece[p] % (1 << 64) for p in pieces]
        u = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
        return u - (1 << 64) if u >> 63 else u

    assert got == {1: votes("abc", "bcd"), 2: votes("ab"), 3: 0, 4: 0, 5: votes("abc", "bc𠀀", "c𠀀d", "xyz"), None: votes("abc", "bcd")}
    assert "Generate" not in plan(out)


def test_trigrams_of_long_lines_take_one_pass(spark):
    rng = np.random.default_rng(2)
    line = "".join(rng.choice(list("abcdefgh "), 60_000))
    began = time.monotonic()
    got = spark.createDataFrame([(line,), ("a b",), ("",), (None,)], "t string").select(retrieval.trigrams(F.col("t")).alias("g")).collect()
    assert time.monotonic() - began < 20
    flat = line.replace(" ", "")
    assert len(got[0]["g"]) == len({flat[i:i + 3] for i in range(len(flat) - 2)}) and [len(r["g"]) for r in got[1:]] == [1, 1, 1]


def test_similar_by_small_tiles_and_copies(spark, monkeypatch):
    monkeypatch.setattr(R, "TILE", 8)
    rng = np.random.default_rng(3)
    near = rng.normal(size=(5, 16))
    v = (near[rng.integers(5, size=90)] + 0.3 * rng.normal(size=(90, 16))).tolist()
    ents = [(i, "e", i % 2, v[i % 40]) for i in range(60)] + [(99, "e", 0, [1.0] * 15 + [None])]
    ments = [(i, "m", i % 2, v[30 + i], "") for i in range(60)]
    got = {(r["mention"], r["entity"]) for r in R.similar(spark.createDataFrame(ments, "mention long, name string, type int, vector array<double>, text string"), spark.createDataFrame(ents, "entity long, name string, type int, vector array<double>")).collect()}
    want = set()
    for m, _, t, x, _ in ments:
        c = [(-round(float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))), 9), e) for e, _, u, y in ents[:-1] if u == t]
        want |= {(m, e) for s, e in sorted(c)[:3] if s <= -0.8}
    assert got == want and got


def test_known_names_are_counted_before_they_meet_mentions(spark, tmp_path):
    spark.range(4000).selectExpr("id AS p_partkey", "'same' AS p_name", "IF(id > 3990, NULL, 'kind') AS p_type", "'b' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 4000, 4).selectExpr("id AS doc_id", "CAST(1 AS INT) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    out = catalogue.queries()["resolve_funnel"](spark, str(tmp_path))
    assert out.groupBy("decision").count().orderBy("decision").collect() == [("ambiguous", 1995), ("new", 5)]
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [name" in joined


def test_lines_of_answers_are_dealt_once(spark):
    text = plan(catalogue.queries()["answer_evaluation"](spark, "/root/testdata/sf0.001"))
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("FileScan") <= 3


def test_edges_are_never_made_distinct_as_a_whole(spark, monkeypatch):
    plans, real = {}, graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: (plans.setdefault(name, plan(df)), real(df, name))[1])
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 3), (None, 1), (3, 4), (9, 8), (8, 9)], "a long, b long")
    assert {tuple(r) for r in graph.neighbourhood(edges, spark.range(1, 2).select(F.col("id").alias("node")), 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert "keys=[a#" not in plans["frontier"]
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert "Aggregate" not in plans["edges"]


def test_graph_files_are_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(stores, "FILE_ROWS", 500)
    path = stores._written(spark, "/root/testdata/sf0.001").removesuffix("/*").removeprefix("file://").removeprefix("file:")
    sizes = [f.read_text().count("<edge ") for f in Path(path, "edges").glob("part-*")]
    assert sum(sizes) > 1000 and max(sizes) <= 500


def test_pairs_of_one_kind_take_one_scan(spark):
    assert plan(catalogue.queries()["triple_difference"](spark, "/root/testdata/sf0.001")).count("FileScan") == 1


def test_claims_of_a_pool_are_placed_once(spark, monkeypatch):
    plans, real = {}, bundles.staged
    monkeypatch.setattr(bundles, "staged", lambda df, name: (plans.setdefault(name, plan(df)), real(df, name))[1])
    catalogue.queries()["bundle_pool"](spark, "/root/testdata/sf0.001")
    assert plans["pool"].count("Window [row_number() windowspecdefinition(l_orderkey") == 1


def test_audits_count_no_support(spark):
    drafts = [c for c in catalogue.queries()["claim_audit"](spark, "/root/testdata/sf0.001").inputFiles() if "/drafts-" in c]
    assert drafts and set(spark.read.parquet(*drafts).columns) == {"id", "subject", "object", "predicate", "cardinality", "failed_stage"}


def test_pieces_of_texts_meet_quotes_as_numbers(spark):
    docs = spark.createDataFrame([(1, "say: the 𠀀quick, brown fox"), (2, "nothing of it"), (3, "a.b"), (None, "the quick brown fox"), (4, None), (5, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "𠀀quick brown"), (2, "quick brown fox"), (3, "."), (4, "absent words"), (5, None)], "item_id long, text string")
    out = texts.quotes_bound(docs, quotes)
    assert {tuple(r)[:3] for r in out.collect()} == {(1, 1, "NORMALIZED"), (1, 2, "NORMALIZED"), (3, 3, "EXACT"), (None, 2, "EXACT")}
    assert "PythonMapInArrow" in plan(out) or "MapInArrow" in plan(out)


def test_pairs_of_parts_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.operators.groups.BLOCK", 20, raising=False)
    spark.range(300).selectExpr("id AS p_partkey", "IF(id % 3 = 0, 'red bolt', 'red rod') AS p_name", "'b' AS p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.queries()["title_jaccard"](spark, str(tmp_path))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == out.distinct().count() == 300 * 299 // 2 and len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
