"""Operators on odd rows and against brute force."""



from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_classifier, quality_rules, quote_linking, token_store, toxicity, warc
from lodestone.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_jaccard_on_odd_rows(odd_docs, no_docs):
    got = sorted(rows(jaccard_join.classes(odd_docs)), key=repr)
    by = {}
    for d, n, c in got:
        by.setdefault(d, set()).add((n, c))
    assert len(got) == 11 and by[1] == by[2] == {(56, 1)} and by[None] == {(56, 1)}
    assert by[3] == {(56, 1)} if 51 * 100 >= 75 * 61 else True
    assert by[4] == {(0, 4)} and by[5] == {(0, 5)} and by[6] == by[7] == {(1, 6)}
    assert rows(jaccard_join.classes(no_docs)) == []


def test_one_of_each_group_stays(spark, odd_docs):
    kept = rows(jaccard_join.pipeline_stage(spark, odd_docs, "").select("doc_id"))
    assert sorted((x[0] for x in kept), key=repr) == sorted([1, 4, 5, 6, 8, 9, None], key=repr)


def test_tokens_on_odd_rows(odd_docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    import zlib

    import numpy as np

    ref = tokenizers.Tokenizer.from_file(token_store.default_tokenizer())
    docs = sorted([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for d, t in docs:
        ids = np.array([*ref.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows(token_store.store(odd_docs)), key=repr) == sorted(want, key=repr)
    assert rows(token_store.store(no_docs)) == []


def test_warc_keeps_payloads_with_separators(spark, tmp_path):
    long_ = "x" * 120
    html = [long_, long_, "a\r\n\r\nb\r\n", "\r\n\r\n", "", None, "WARC/1.1\r\n\r\n" + "y" * 100 + "\r\n", "short", "short"]
    pages = spark.createDataFrame([(i, f"http://h.org/{i % 3}", h) for i, h in enumerate(html)] + [(None, None, long_)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 10 and {k: got[k]["payload_bytes"] for k in range(9)} == {k: len((h or "").encode()) for k, h in enumerate(html)}
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 0 and got[8]["record_type"] == "response" and got[None]["record_type"] == "response"
    h = warc.histories(warc.read(spark, str(tmp_path / "w"))).where("url = 'http://h.org/0'").orderBy("capture_no")
    assert [(r["page_id"], r["capture_no"]) for r in h.collect()] == [(0, 1), (3, 2), (6, 3)]


def test_rules_on_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in quality_rules.judged(odd_docs).collect()}
    assert got[4]["base_failed"] and got[4]["n_words"] == 0 and not got[1]["base_failed"]
    assert rows(quality_rules.judged(no_docs)) == []


def test_classifiers_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (toxicity.scores, quality_classifier.scores):
        got = f(odd_docs, labels).collect()
        assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
        assert f(no_docs, labels.limit(0)).collect() == []


def test_mixing_meets_targets(spark, odd_docs, no_docs):
    en, de = "the of and to in is for on with as by at", "der die und das von mit ist im den zu ein auf"
    docs = spark.createDataFrame([(i, " ".join([en if i % 4 else de] * 5), "en" if i % 4 else "de") for i in range(400)], "doc_id long, text string, lang string")
    out, report = mixing.rates(docs)
    assert abs(report["reached"] - report["target"]).max() <= 0.001 * report["target"].max()
    total = out.agg(F.sum(F.col("rate") * F.col("n_tokens"))).first()[0]
    assert abs(total - report["target"].sum()) < 0.01 * total
    kept = mixing.pipeline_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == 400
    assert mixing.rates(odd_docs)[0].count() == 11 and mixing.rates(no_docs)[0].count() == 0


def test_decontamination_on_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 40))), (2, None), (3, ""), (None, "a b")], "item_id long, text string")
    got = sorted(rows(decontaminate.leaks(odd_docs, bench)), key=repr)
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 1, 0), (2, 1, 0), (3, 1, 1), (None, 1, 0)}
    assert rows(decontaminate.leaks(no_docs, bench)) == [] and rows(decontaminate.leaks(odd_docs, bench.limit(0))) == []


def test_line_dedup_against_all_pairs(spark):
    base = [f"w{i}" for i in range(30)]
    texts = ["\n".join([" ".join(base), "short line", ""]), "\n".join([" ".join([*base[:29], "z"]), "Short  line", "other words here"]), None, " ".join(base[:12]), "short line\nshort line"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            sets.append((d, n, set(w)))
    want = {d: [] for d in range(len(texts))}
    for k, (d, n, s) in enumerate(sets):
        if s and any(x[2] and 100 * len(s & x[2]) >= 75 * len(s | x[2]) for x in sets[:k]):
            want[d].append(n)
    assert {r["doc_id"]: r["removed"] for r in line_dedup.deduplicated(docs).collect()} == want


def test_quotes_link_to_originals(spark, tmp_path):
    msgs = [
        (1, 0, "user", "How are you?\nI am fine."), (1, 1, "assistant", "> How are you?\nWell, thanks."), (1, 2, "user", "On Monday X wrote:\n> Well, thanks.\n>> How are you?\nGood!"),
        (1, 3, None, "> never said\nhm"), (2, 0, "user", "> How are you?\nelsewhere"), (1, 4, "user", None), (None, None, "user", "> Good!"), (1, 2, "user", "On Monday X wrote:\n> Well, thanks.\n>> How are you?\nGood!"),
    ]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["root_turn"], r["depth"], r["text"]) for r in quote_linking.linked(df).collect()}
    assert got[1, 1] == (0, 0, 1, "Well, thanks.") and got[1, 2] == (1, 0, 2, "Good!") and got[1, 3] == (None, 3, 0, "hm") and got[2, 0] == (None, 0, 0, "elsewhere")
    assert got[1, 4][3] == "" and quote_linking.linked(df).count() == len(msgs)
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    rel = con.sql(quote_linking.SQL)
    cols = quote_linking.linked(df).columns
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(rows(quote_linking.linked(df)), key=repr) == want


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = Q.queries()[name](spark, str(DATA)), con.sql(Q.oracle_sql()[name])
    cols = df.columns
    assert sorted(cols) == sorted(rel.columns)
    assert sorted(map(repr, rows(df))) == sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())


