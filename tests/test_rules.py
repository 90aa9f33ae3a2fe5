"""Column rules on literal cases worked out by reading."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import calendar, scoring, text, url


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTP://A.com/x/?utm_source=1&b=2#f", "http://a.com/x?b=2"), ("https://h.org", "https://h.org/"), ("https://h.org/", "https://h.org/"),
    ("https://h.org/p?from=a&friend=b&ref=x", "https://h.org/p?ref=x"), ("https://h.org/p?a=", "https://h.org/p?a="),
])
def test_canonical_urls(spark, raw, want):
    assert one(spark, url.canonicalize(F.lit(raw))) == want


@pytest.mark.parametrize(("domain", "kind", "level"), [("www.gov.cn", "Government", "S"), ("x.edu.cn", "University", "A"), ("kaogu.cssn.cn", "AcademicJournal", "A"), ("city-museum.org", "Museum", "A"), ("m.weibo.com", "GeneralWebsite", "C"), ("a.b", "GeneralWebsite", "UNKNOWN")])
def test_source_ladder(spark, domain, kind, level):
    r = one(spark, url.source_class(F.lit(domain)))
    assert (r["source_type"], r["authority"]) == (kind, level)


@pytest.mark.parametrize(("quote", "chunk", "want"), [("abcdef", "xxabcdefyy", "EXACT"), ("ab, cd. ef", "xx abcdef yy", "NORMALIZED"), ("ab, cd", "abcd", "FAILED"), ("", "a", "FAILED"), (None, "a", "FAILED")])
def test_quote_binding(spark, quote, chunk, want):
    assert one(spark, text.bind(F.lit(quote).cast("string"), F.lit(chunk))) == want


def test_calendar(spark):
    cases = [("光绪二十五年", 1899, 1899, "清"), ("90年代", 1900, 1909, None), ("庚子年", 1900, 1900, None), ("南宋绍兴年间", 1127, 1279, "南宋"), ("1927年8月1日", 1927, 1927, None), ("公元前256年", -256, -256, None), ("none", None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "raw string").withColumn("p", calendar.parse(F.col("raw")))  # one plan: it is long
    assert {(r["raw"], r["valid_from"], r["valid_to"], r["dynasty"]) for r in df.select("raw", "p.valid_from", "p.valid_to", "p.dynasty").collect()} == set(cases)


@pytest.mark.parametrize(("claims", "independent", "score", "kind", "tenths"), [(0, 0, 0.0, "EMPTY", 8), (2, 0, 0.1, "VERY_LOW", 7), (2, 1, 0.1625, "SINGLE_SOURCE", 6), (3, 1, 0.2125, "LOW_EVIDENCE", 6), (5, 2, 0.375, None, None)])
def test_gap_grades(spark, claims, independent, score, kind, tenths):
    g = scoring.gap_type(F.lit(claims), F.lit(independent), F.lit(score))
    assert one(spark, g) == kind
    if kind:
        assert one(spark, scoring.gap_priority(g, F.lit(independent))) == tenths


@pytest.mark.parametrize(("n", "level", "match", "time", "specific", "contested", "want"), [(1, "UNKNOWN", "NORMALIZED", False, False, False, 35), (1, "A", "EXACT", True, True, False, 80), (3, "S", "EXACT", True, True, False, 95), (9, "S", "EXACT", True, True, True, 30)])
def test_confidence(spark, n, level, match, time, specific, contested, want):
    assert one(spark, scoring.confidence(F.lit(n), F.lit(level), F.lit(match), F.lit(time), F.lit(specific), F.lit(contested))) == want


@pytest.mark.parametrize(("sample", "violations", "least", "absent", "want"), [(0, 0, 1, True, "FAIL_CAPABILITY_ABSENT"), (23, 0, 30, False, "NOT_MEASURED"), (40, 0, 30, False, "PASS"), (40, 1, 30, False, "FAIL")])
def test_gates(spark, sample, violations, least, absent, want):
    assert one(spark, scoring.gate(F.lit(sample), F.lit(violations), F.lit(least), F.lit(absent))) == want


def test_grams_and_simhash_piece(spark):
    assert one(spark, text.grams(F.lit("a b\tcd"), 3)) == ["abc", "bcd"]
    assert one(spark, text.grams(F.lit("ab"), 3)) == ["ab"]
    assert one(spark, text.grams(F.lit(" "), 3)) == []
    assert one(spark, text.simhash_bits(F.lit("abc"))) == int.from_bytes(hashlib.md5(b"abc").digest()[:8], "big", signed=True)


def test_main_text(spark):
    html = "<html><head><script>var t='</p>';</script></head><body><nav>x</nav><p>Hello <b>there</b></p></body></html>"
    assert one(spark, text.main_text(F.lit(html))).split() == ["Hello", "there"]
