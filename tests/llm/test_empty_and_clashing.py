"""Empty tables and columns with names that operators use, for the operators that lacked such a test."""

from lodestone.llm import line_dedup, quote_linking, warc

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicated(docs).count() == 0 and line_dedup.without_removed(docs).count() == 0
    assert quote_linking.conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op7_warc(spark, str(tmp_path)).count() == 0


def test_lines_of_tables_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d\nx", 7, "r", "w"), (2, "a b c d\ny", 7, "r", "w")], "doc_id long, text string, id long, row string, words string")
    assert {r["doc_id"]: r["removed"] for r in line_dedup.deduplicated(docs).collect()} == {1: [], 2: [0]}
    out = line_dedup.without_removed(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b c d\nx", 2: "y"}


def test_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "user", "hello there", 5, "x"), (1, 1, "assistant", "> hello there\nyes", 5, "x")]
    got = quote_linking.conversations(spark.createDataFrame(rows, CONVERSATIONS + ", root long, parent string")).collect()
    assert [(r["conv_id"], r["turn"], r["thread"], r["position"]) for r in got] == [(1, 0, 0, 0), (1, 1, 0, 1)]


def test_captures_of_tables_with_clashing_columns(spark, tmp_path):
    body = "x" * 200
    rows = [(1, "http://b/", body, "p", 1), (2, "http://a/", body, "p", 1), (3, "http://a/", "small", "p", 1), (4, None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type long").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (200, "response", None), 2: (200, "revisit", 1), 3: (5, "response", None), 4: (0, "response", None)}
