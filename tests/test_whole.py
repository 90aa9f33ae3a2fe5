"""Queries over all rows, held against brute force on the smallest tables or on small fixtures."""

import os
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from lodestone.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def run(spark, name, sf_dir=DATA):
    return catalogue.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def cube():
    order = {r["o_orderkey"]: r for r in read("orders")}
    home = {r["c_custkey"]: r["c_nationkey"] for r in read("customer")}
    region = {r["r_regionkey"]: r["r_name"] for r in read("region")}
    of = {r["n_nationkey"]: region[r["n_regionkey"]] for r in read("nation")}
    brand = {r["p_partkey"]: r["p_brand"] for r in read("part")}
    claims, sources = defaultdict(int), defaultdict(set)
    for r in read("lineitem"):
        o = order.get(r["l_orderkey"])
        if o is None or r["l_partkey"] not in brand or home.get(o["o_custkey"]) not in of:
            continue
        cell = of[home[o["o_custkey"]]], r["l_shipdate"].year, o["o_orderpriority"]
        claims[cell] += 1
        sources[cell, brand[r["l_partkey"]]].add(o["o_custkey"])
    independent = defaultdict(int)
    for (cell, _), s in sources.items():
        independent[cell] += len(s)
    return {c: (n, independent[c]) for c, n in claims.items()}


def test_cube_counts_all_claims(spark, cube):
    got = {(r["region"], r["year"], r["priority"]): (r["claims"], r["independent"]) for r in run(spark, "coverage_cube_all")}
    assert got == cube
    assert {(r["region"], r["year"]) for r in run(spark, "gap_autoresolve_all")} == {(a, y) for (a, b, _), (n, _) in cube.items() if n >= 2 for y in (None, b) if y in (None, 1995)}


def test_gaps_are_cells_without_enough_claims(spark, cube):
    years, priorities = {r["l_shipdate"].year for r in read("lineitem")}, {r["o_orderpriority"] for r in read("orders")}
    want = {}
    for cell in ((r["r_name"], y, p) for r in read("region") for y in years for p in priorities):
        n, k = cube.get(cell, (0, 0))
        gap = "EMPTY" if n == 0 else "VERY_LOW" if k == 0 else "SINGLE_SOURCE" if k <= 1 and n < 3 else "LOW_EVIDENCE" if 4 * n + 5 * k < 20 else None
        if gap:
            want[cell] = gap
    assert {(r["region"], r["year"], r["priority"]): r["gap"] for r in run(spark, "gap_grid_all")} == want


def test_pairs_that_trade_are_no_gap(spark):
    order, home, at = {r["o_orderkey"]: r["o_custkey"] for r in read("orders")}, {r["c_custkey"]: r["c_nationkey"] for r in read("customer")}, {r["s_suppkey"]: r["s_nationkey"] for r in read("supplier")}
    trade = {frozenset((home.get(order.get(r["l_orderkey"])), at.get(r["l_suppkey"]))) for r in read("lineitem")}
    n = read("nation")
    want = {(x["n_name"], y["n_name"]) for x in n for y in n if x["n_regionkey"] == y["n_regionkey"] and x["n_name"] < y["n_name"] and frozenset((x["n_nationkey"], y["n_nationkey"])) not in trade}
    assert {(r["a"], r["b"]) for r in run(spark, "symmetric_pair_gap_all")} == want


def test_graph_has_all_edges(spark):
    near = defaultdict(set)
    for r in read("lineitem"):
        near[r["l_suppkey"]].add(r["l_partkey"] + 1000000)
        near[r["l_partkey"] + 1000000].add(r["l_suppkey"])
    hops, frontier = {1: 0}, {1}
    for hop in (1, 2, 3):
        frontier = {y for x in frontier for y in near[x]} - set(hops)
        hops |= dict.fromkeys(frontier, hop)
    assert {r["node"]: r["hop"] for r in run(spark, "bfs_neighborhood_all")} == hops
    root = {}
    for x in sorted(near):
        todo = [] if x in root else [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = x
                todo += near[y]
    assert {r["node"]: r["root"] for r in run(spark, "graph_components")} == root


def test_titles_of_all_parts(spark, tmp_path):
    names = ["red widget", "Red Widgets", "blue bolt", "q", "Q", "zz", None, "red widget"]
    parts = [(i, n, b, 1 + i % 3) for b, k in (("A", 0), ("B", 100)) for i, n in enumerate(names, k)] + [(900, "red widget", None, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))

    def grams(t):
        x = "".join((t or "").lower().split())
        return {x[i : i + 2] for i in range(len(x) - 1)} or ({x} if x else set())

    want = {(a, b, len(grams(m) & grams(n)), len(grams(m) | grams(n))) for a, m, x, _ in parts for b, n, y, _ in parts if a < b and x == y and x and grams(m) & grams(n)}
    got = [tuple(r) for r in run(spark, "title_jaccard_all", str(tmp_path))]
    assert len(got) == len(set(got)) and set(got) == want


def test_quotes_bind_with_other_punctuation(spark, tmp_path):
    from lodestone.plans import texts

    def form(x):
        import re

        return re.sub(texts.text.SCAN_MARKS, "", re.sub(texts.text.PUNCTUATION, "", x))

    docs = [(1, "The river, rises in spring; and\nfalls in autumn."), (2, "x" * 1190 + " the river rises in spring and falls in autumn"), (3, "no"), (None, "the river  rises in spring"), (4, None), (5, ""), (6, "a. b. c"),
            (7, "y" * 2500 + "The river, rises in spring"), (1, "the river rises in spring"), (8, "《大江东去》，浪淘尽，千古风流人物"), (9, "ab cde.f"), (10, "so: \U0001f600 a, bright day")]
    quotes = [(1, "the river rises in spring"), (2, "The river rises in spring"), (3, "a. b"), (4, "ab"), (5, None), (6, ""), (7, "..."), (8, "大江东去浪淘尽"), (9, "abcdef"), (10, "The river, rises in spring"), (None, "no"), (11, "\U0001f600 a bright, day")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(quotes, "item_id long, text string")
    want = set()
    for i, t in docs:
        for k, x in quotes:
            if not t or not x:
                continue
            match = "EXACT" if x in t else "NORMALIZED" if len(form(x)) >= 6 and form(x) in form(t) else None
            if match:
                parts = [t[j : j + 1200] for j in range(0, len(t), 1200)]
                rules = [lambda c: x in c, lambda c: form(x) and form(x) in form(c), lambda c: len(form(x)) >= 16 and form(x)[:16] in form(c)]
                want.add((i, k, match, next((n for rule in rules for n, c in enumerate(parts) if rule(c)), None)))
    got = [tuple(r) for r in texts.quotes_bound(d, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {m for _, _, m, _ in want} == {"EXACT", "NORMALIZED"}
    assert {p for i, _, _, p in want if i in (2, 7)} == {None, 2}
