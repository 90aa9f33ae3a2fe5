"""Skewed mixing, failing hosts, colliding lines, the pipeline, and columns that clash."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, line_dedup, mixing, quality_rules, token_store


def test_mixing_with_a_rare_domain_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 7, 8), (2, "a b d", "en", 7, 8), (3, "a c", "en", 7, 8), (4, "", "de", 7, 8)], "doc_id long, text string, lang string, _copies int, _copy int")
    out = mixing.mixed(docs, most=16.0)
    assert out.columns == docs.columns and out.count() >= 4
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 16


def test_mixing_tells_rows_without_ids_apart(spark):
    def copies_of(ids):
        rows = [(ids(i), " ".join(f"e{(i * 7 + k) % 50}" for k in range(30)), "en") for i in range(100)] + [(ids(100), " ".join(f"d{k}" for k in range(30)), "de")]
        out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        return {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()}

    own = copies_of(lambda i: i)
    assert own["en"] == 100 and own["de"] > 5
    assert copies_of(lambda i: None) == own or abs(copies_of(lambda i: None)["de"] - own["de"]) <= 1
    assert copies_of(lambda i: 7)["en"] == 100


def test_mixing_reaches_targets_of_rare_domains(spark):
    rows = [(i, " ".join(f"e{(i * 7 + k) % 50}" for k in range(40)), "en") for i in range(300)] + [(300, "d0 d1 d2 d3 d4 d5 d6", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    report = mixing.rates(docs)[1]
    assert abs(report["reached"] - report["target"]).max() <= 0.01 * report["target"].max()
    assert mixing.rates(docs, most=16.0)[1]["reached"].min() < 0.5 * report["target"].min()


def test_mixing_without_repeats_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'abcd'[d]}{rng.integers(40)}" for _ in range(30)), "abcd"[d]) for i, d in enumerate(rng.choice(4, 400, p=[0.7, 0.1, 0.1, 0.1]))]
    docs = spark.createDataFrame([(i, t, d) for i, t, d in rows], "doc_id long, text string, lang string")
    out, report = mixing.rates(docs, weights=dict.fromkeys("abcd", 1.0), repeat=False)
    assert abs(report["reached"] - report["target"]).max() <= 0.01 * report["target"].max()
    rates = {r["doc_id"]: r["rate"] for r in out.select("doc_id", "rate").collect()}
    assert min(rates.values()) >= 0 and min(rates.values()) < 1
    # the objective against plain projected gradient descent over all rates
    p = np.array([r["p"] for r in out.orderBy("doc_id").select("p").collect()])
    n = np.array([r[0] for r in out.orderBy("doc_id").select("n_tokens").collect()], float)
    a, target = (p * n[:, None]).T, report["target"]
    r = np.ones(len(n))
    for _ in range(4000):
        r = np.clip(r - a.T @ (a @ r - target) / np.linalg.norm(a @ a.T, 2), 0, None)
    mine = np.array([rates[i] for i in range(len(rows))])
    assert np.sum((a @ mine - target) ** 2) <= np.sum((a @ r - target) ** 2) + 1e-4 * np.sum(target**2)
    kept = mixing.mixed(docs, weights=dict.fromkeys("abcd", 1.0), repeat=False).groupBy("lang").count().collect()
    assert all(abs(x["count"] - 100) < 35 for x in kept)


def test_hosts_fail_and_single_pages_do_not(spark, tmp_path):
    clean = " ".join(f"word{i}" for i in range(30))
    rows = [(i, clean + f" x{i}", "good") for i in range(90)] + [(100 + i, "too short", "bad") for i in range(25)] + [(150, clean, "bad"), (200, "short", "one"), (201, clean, None), (202, None, "two")]
    rows += [(300 + i, clean + f" y{i}" if i else "short", f"h{i // 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_rules.op10_quality_rules(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(quality_rules.SQL)
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[150]["host_failed"] and not by[150]["kept"] and not by[200]["host_failed"] and by[201]["kept"] and not by[202]["kept"]


def test_lines_whose_short_hashes_agree_stay(spark):
    docs = spark.createDataFrame([(1, "w13482192\nb a"), (2, "w17530186\na b\na b c d e f g"), (3, "g f e d c b a x")], "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.deduplicated(docs).collect()} == {1: [], 2: [1], 3: [0]}


def test_line_dedup_splits_frequent_lists(spark, monkeypatch):
    """Every list is split by length and by removal; the rows are those of all pairs."""
    monkeypatch.setattr(line_dedup, "OFTEN", 2)
    monkeypatch.setattr(line_dedup, "VERY_OFTEN", 4)
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    rng = np.random.default_rng(5)
    texts = ["\n".join(" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, rng.integers(1, 14)), 30)) for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [(d, n, set(line.split())) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
    want = {d: [] for d in range(len(texts))}
    for k, (d, n, s) in enumerate(sets):
        if any(100 * len(s & x) >= 75 * len(s | x) for _, _, x in sets[:k]):
            want[d].append(n)
    assert {r["doc_id"]: r["removed"] for r in line_dedup.deduplicated(docs).collect()} == want


def test_token_shards_are_bounded_by_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} and some more words, here.\nA line" * (1 + i % 3)) for i in range(50)] + [(None, "x"), (7, "again")], "doc_id long, text string")
    want = sorted(map(tuple, token_store.store(docs).collect()), key=repr)
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 40)
    assert sorted(map(tuple, token_store.store(docs).collect()), key=repr) == want


def edited(rng, w, most):
    """Changes, inserts and drops."""
    w = list(w)
    for _ in range(most):
        how, at = rng.integers(3), int(rng.integers(len(w)))
        w[at : at + (how < 2)] = [f"z{rng.integers(10**6)}"] * int(how > 0)
    return w


def found_in(index, docs):
    words = decontaminate.item_words(pa.array([" ".join(d) for d in docs]))
    first = np.append(0, np.cumsum([len(x) for x in words]))
    return {(d, item): dist for d, item, dist, _, _ in index.leaks(np.concatenate(words), first)}


def test_benchmarks_of_one_item_are_found():
    rng = np.random.default_rng(5)
    hit = total = 0
    for size in [8] * 60 + [9] * 20 + [12] * 20 + [30] * 10:
        item = [f"i{rng.integers(10**6)}" for _ in range(size)]
        index = decontaminate.Index([1], decontaminate.item_words(pa.array([" ".join(item)])))
        docs = [[f"p{rng.integers(10**6)}" for _ in range(20)] + edited(rng, item, size // 4) + [f"s{rng.integers(10**6)}" for _ in range(20)] for _ in range(10)]
        hit += len(found_in(index, docs))
        total += len(docs)
    assert hit >= 0.95 * total
    for k in range(300):  # rates that once were 0
        item = [f"{c}{k}" for c in "abcdefghi"]
        assert found_in(decontaminate.Index([1], decontaminate.item_words(pa.array([" ".join(item)]))), [["x", *item, "y"]]) == {(0, 0): 0}


def test_the_least_distance_is_reported():
    rng = np.random.default_rng(6)
    item = [f"i{rng.integers(10**6)}" for _ in range(20)]
    index = decontaminate.Index([1], decontaminate.item_words(pa.array([" ".join(item)])))
    docs = [[f"p{rng.integers(10**6)}" for _ in range(int(rng.integers(5)))] + edited(rng, item, 3) + item + ["s"] * 9 for _ in range(80)]
    assert found_in(index, docs) == {(d, 0): 0 for d in range(80)}


def test_items_that_share_words_are_all_found():
    rng = np.random.default_rng(8)
    base = [f"i{rng.integers(10**6)}" for _ in range(24)]
    items = [base, base[:12] + [f"j{k}" for k in range(12)], edited(rng, base, 4), [f"k{k}" for k in range(16)]]
    index = decontaminate.Index([1, 2, 3, 4], decontaminate.item_words(pa.array([" ".join(w) for w in items])))
    for item in range(4):
        assert found_in(index, [["a", "b", *items[item], "c"]])[0, item] == 0


def test_decontamination_recall_of_edited_copies(spark):
    rng = np.random.default_rng(11)
    items = [[f"q{rng.integers(10**6)}" for _ in range(int(rng.integers(15, 40)))] for _ in range(60)]
    rows = []
    for k, w in enumerate(items):
        for c in range(4):
            copy = list(w)
            for at in rng.permutation(len(w))[: len(w) // (8 if c % 2 else 4)]:
                copy[at] = f"z{rng.integers(10**6)}"
            rows.append((k * 10 + c, " ".join([f"p{rng.integers(10**6)}" for _ in range(50)] + copy + ["end"] * 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(found & {(d, d // 10) for d, _ in rows}) >= 0.95 * len(rows) and found <= {(d, d // 10) for d, _ in rows}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline_keeps_what_it_should(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    stage = dict(corpus_pipeline.STAGES)
    assert stage["near_duplicates"](spark, docs, d).columns == docs.columns
    clean = stage["decontamination"](spark, docs, d)
    leaking = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert leaking and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - leaking
    assert decontaminate.leaks(clean, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.run(spark, d)
    got = out.orderBy("start").collect()
    assert got and [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert not {r["doc_id"] for r in got} & leaking


def _candidates(spark, monkeypatch, texts):
    """What is removed, and how many pairs were candidates after the leaders."""
    later, seen = line_dedup._later, []
    monkeypatch.setattr(line_dedup, "_later", lambda docs, classes, pairs: seen.append(pairs.count()) or later(docs, classes, pairs))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in line_dedup.deduplicated(docs).collect() if r["removed"]}, seen[0]


def test_line_dedup_long_lines_of_common_words_are_no_candidates(spark, monkeypatch):
    rng = random.Random(3)
    gone, pairs = _candidates(spark, monkeypatch, [" ".join(f"w{rng.randrange(1400)}" for _ in range(300)) for _ in range(120)])
    assert not gone and pairs < 120


def test_line_dedup_near_copies_find_leaders_among_themselves(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join([*common, *(f"u{rng.randrange(10**6)}" for _ in range(45))]) for _ in range(40)]
    base = [*common, *(f"b{i}" for i in range(45))]
    for _ in range(120):
        spoilt = set(rng.sample(range(75), 5))
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if i in spoilt else w for i, w in enumerate(base)))
    sets = [set(t.split()) for t in texts]
    want = {j for j, s in enumerate(sets) if any(100 * len(s & t) >= 75 * len(s | t) for t in sets[:j])}
    gone, pairs = _candidates(spark, monkeypatch, texts)
    assert gone == want and len(want) > 100 and pairs < 400
