"""Text and URL queries: the column rules of ``lodestone.functions`` over the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, text, url
from ..operators import groups
from ..operators.staging import staged
from ..sources import table
from . import query

_RE = text.PUNCTUATION, text.SCAN_MARKS


@query("url_canonicalize", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS s, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS h,
  regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS d, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_|spm|from|fr|share_|isapp|scene|subscene|refer|sharer|tdsourcetag)')), '&') AS kept, regexp_replace(d, '/+$', '') AS path FROM p)
SELECT page_id, lower(s) || '://' || lower(h) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical, lower(h) AS domain FROM k""")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1, FN-2."""
    return table(spark, sf_dir, "pages").select("page_id", url.canonicalize(F.col("url")).alias("canonical"), url.domain_of(F.col("url")).alias("domain"))


#: Hosts that reach every rung, and some that come close.
HOSTS = ["www.gov.cn", "wwwxgov.cn", "moj.gov.cn", "gov.cn", "pku.edu.cn", "kns.cnki.net", "www.people.com.cn", "wh.hubei.gov.cn", "zh.wikipedia.org", "city-museum.org", "wwwlibrary.com", "www.zhihu.com", "v.qq.com", "example.com", "MOJ.GOV.CN:8080", "www.cctv.com", "shanghai.archives.sohu.com"]
_HOSTS = "(VALUES " + ", ".join(f"({-1 - i}, 'http://{h}/x')" for i, h in enumerate(HOSTS)) + ") v(page_id, url)"
#: The ladder once more, as suffixes and parts of hosts.
_ENDS = {"AcademicJournal": "cnki.net wanfangdata.com.cn cssn.cn cnki.com.cn cqvip.com", "Newspaper": "people.com.cn xinhuanet.com news.cn cctv.com cntv.cn chinanews.com chinanews.com.cn thepaper.cn gmw.cn cnr.cn legaldaily.com.cn china.com.cn china.com yicai.com caixin.com hubei.gov.cn"}


@query("source_classify", f"""WITH p AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {_HOSTS}), h AS (SELECT page_id, lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) AS h FROM p)
SELECT page_id, CASE WHEN h IN ('www.gov.cn', 'www.sach.gov.cn', 'www.ncha.gov.cn', 'www.whc.unesco.org') OR suffix(h, '.gov.cn') THEN 'Government' WHEN suffix(h, '.edu.cn') THEN 'University'
  {" ".join("WHEN " + " OR ".join(f"suffix(h, '{e}')" for e in ends.split()) + f" THEN '{kind}'" for kind, ends in _ENDS.items())} WHEN suffix(h, 'wikipedia.org') OR suffix(h, 'britannica.com') THEN 'GeneralWebsite'
  WHEN contains(h, 'museum') OR contains(h, 'bowuguan') OR contains(h, 'library') OR contains(h, 'archives') OR contains(h, 'dangan') THEN 'Museum' ELSE 'GeneralWebsite' END AS source_type FROM h""")
def source_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-7: the class of each page's host, and of literal hosts."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url").union(spark.createDataFrame([(-1 - i, f"http://{h}/x") for i, h in enumerate(HOSTS)], "page_id long, url string"))
    return pages.select("page_id", url.source_class(url.domain_of(F.col("url")))["source_type"].alias("source_type"))


@query("html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4; tested against a parser in tests/."""
    return table(spark, sf_dir, "pages").select("page_id", text.main_text(F.col("html")).alias("text"))


@query("quality_filter", r"SELECT doc_id, length(text) < 300 OR len(regexp_extract_all(substr(text, 1, 2000), '[。！？.!?\n]')) / least(length(text), 2000) < 0.01 AS garbage, sha256(text) AS text_sha256 FROM documents")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5, FN-6."""
    return table(spark, sf_dir, "documents").select("doc_id", text.garbage(F.col("text")).alias("garbage"), F.sha2("text", 256).alias("text_sha256"))


@query("chunk_split", "SELECT doc_id, CAST(i AS INTEGER) AS part, substr(text, CAST(i * 1200 + 1 AS BIGINT), 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1200.0) AS BIGINT))) AS i FROM documents)")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("part", "chunk"))


@query("balanced_split", """SELECT doc_id, CAST(CASE WHEN length(text) < 800 THEN 0 WHEN b > 0 THEN m + b - 1 WHEN l > 0 THEN m + l - 1 ELSE 0 END AS INTEGER) AS cut
FROM (SELECT doc_id, text, length(text) // 2 AS m, instr(substr(text, length(text) // 2 + 1, 2001), chr(10) || chr(10)) AS b, instr(substr(text, length(text) // 2 + 1), chr(10)) AS l FROM documents)""")
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-20."""
    return table(spark, sf_dir, "documents").select("doc_id", text.split_point(F.col("text")).alias("cut"))


_PIECE = 6


def _piece_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, heads of (key, form): a number for each different piece of ``_PIECE`` characters; equal pieces have equal ones."""
    for batch in batches:
        found = []
        for form in batch.column(1).to_pylist():
            c, h = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.uint64(0)
            for k in range(_PIECE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[k:len(c) - _PIECE + 1 + k]
            found.append(np.unique(h).view(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
        heads = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), heads], names=["key", "heads"])


def quotes_bound(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, item_id, match (EXACT or NORMALIZED), part of docs(doc_id, text) and quotes(item_id, text).

    ``part`` is the first chunk that has the quote, as written before as normalised, else
    by its first 16 normalised characters; null where none has, as for quotes across chunks.
    Quotes and texts meet by the ``_PIECE`` first characters of the quote's bind form, which
    every text that binds has in its own; quotes of shorter forms bind only EXACT and meet
    all texts, as a broadcast of those few.
    """
    q = quotes.where("text is not null and text <> ''").select("item_id", F.col("text").alias("quote"), text.bind_form(F.col("text")).alias("q_form"))
    long_, short = q.where(F.length("q_form") >= _PIECE), q.where(F.length("q_form") < _PIECE)
    d = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", text.bind_form(F.col("text")).alias("form"))
    # pieces meet as numbers; the texts of what meets are compared below
    numbers = lambda rows, key, form: rows.select(F.struct(*key).alias("key"), form.alias("form")).mapInArrow(_piece_numbers, f"key {rows.select(F.struct(*key).alias('key')).schema['key'].dataType.simpleString()}, heads array<bigint>")
    asked = numbers(long_, ["item_id", "quote", "q_form"], F.substring("q_form", 1, _PIECE)).select("key.*", F.explode("heads").alias("head"))
    heads = staged(asked, "heads")
    met = numbers(d.where(F.length("form") >= _PIECE), ["key", "doc_id"], F.col("form")).select("key.*", F.explode("heads").alias("head"))
    pairs = met.join(heads, "head").select("key", "doc_id", "item_id", "quote", "q_form").distinct()
    near = pairs.join(d.select("key", F.col("doc_id").alias("_d"), "text", "form"), "key").where(F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "text", "form", "item_id", "quote", "q_form")
    near = near.union(d.select("doc_id", "text", "form").join(F.broadcast(short), F.contains("text", "quote")).select("doc_id", "text", "form", "item_id", "quote", "q_form"))
    match = F.when(F.contains("text", "quote"), "EXACT").when((F.length("q_form") >= _PIECE) & F.contains("form", "q_form"), "NORMALIZED")
    bound = near.withColumn("match", match).where("match is not null").withColumn("chunks", text.chunks(F.col("text")))

    def first(has) -> Column:
        return F.get(F.filter(F.transform("chunks", lambda c, i: F.when(has(c), i)), lambda x: x.isNotNull()), F.lit(0))

    head = F.substring("q_form", 1, 16)
    part = F.coalesce(
        first(lambda c: F.contains(c, F.col("quote"))),
        F.when(F.col("q_form") != "", first(lambda c: F.contains(text.bind_form(c), F.col("q_form")))),
        F.when(F.length("q_form") >= 16, first(lambda c: F.contains(text.bind_form(c), head))),
    )
    return bound.select("doc_id", "item_id", "match", part.alias("part")).distinct()


_FORM = "regexp_replace(regexp_replace({x}, '[[:space:]　，。、；：？！“”‘’\"''（）()\\[\\]【】《》<>—\\-–_…·,.:;?!※◆●★☆→↑↓〓◎§]+', '', 'g'), '[⺀-⺟⻀-⻳〇○●◇◆□■△▲▽]', '', 'g')"
_CUT = "list_transform(range(0, CAST(ceil(length(text) / 1200.0) AS BIGINT)), lambda i: {x})"
_CHUNK = "substr(text, i * 1200 + 1, 1200)"
_BIND = f"""WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, text, {_FORM.format(x="text")} AS form FROM documents WHERE text IS NOT NULL), q AS (SELECT DISTINCT item_id, text AS quote, {_FORM.format(x="text")} AS q_form FROM benchmark WHERE text <> ''),
m AS (SELECT *, CASE WHEN contains(text, quote) THEN 'EXACT' ELSE 'NORMALIZED' END AS match FROM d JOIN q ON contains(text, quote) OR (length(q_form) >= 6 AND contains(form, q_form)))
SELECT DISTINCT doc_id, item_id, match, CAST(coalesce(list_position({_CUT.format(x=f"contains({_CHUNK}, quote)")}, true), CASE WHEN q_form <> '' THEN list_position({_CUT.format(x=f"contains({_FORM.format(x=_CHUNK)}, q_form)")}, true) END,
  CASE WHEN length(q_form) >= 16 THEN list_position({_CUT.format(x=f"contains({_FORM.format(x=_CHUNK)}, left(q_form, 16))")}, true) END) - 1 AS INT) AS part FROM m"""


@query("quote_bind", _BIND)
@query("quote_bind_all", _BIND)
def quote_bind_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-16, FN-17, FN-21: EXACT and NORMALIZED bindings of all quotes and their chunk."""
    return quotes_bound(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TITLES = r"""WITH t AS (SELECT p_partkey, p_brand, lower(regexp_replace(p_name, '\s', '', 'g')) AS x FROM part),
g AS (SELECT p_partkey, p_brand, CASE WHEN length(x) >= 2 THEN list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, CAST(i AS BIGINT), 2))) ELSE [x] END AS s FROM t),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(len(list_intersect(a.s, b.s)) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(a.s, b.s))) AS BIGINT) AS either FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT * FROM p WHERE common > 0"""


@query("title_jaccard", _TITLES)
@query("title_jaccard_all", _TITLES)
def title_jaccard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12 over all parts: pairs of a brand that share a 2-gram (of others the similarity is 0).

    Titles are compared once a pair of distinct titles of a brand; every pair of parts is a row, made at the end from blocks of parts.
    """
    p = table(spark, sf_dir, "part").where("p_brand is not null").select("p_partkey", "p_brand", "p_name")
    g = p.select("p_brand", "p_name").distinct().withColumn("s", text.grams(F.lower("p_name"), 2))
    sets = g.select("p_brand", "p_name", F.size("s").alias("n"), F.explode("s").alias("g"))
    a, b = sets.alias("a"), sets.alias("b")
    met = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.p_name") <= F.col("b.p_name")))
    links = met.groupBy(F.col("a.p_brand").alias("p_brand"), F.col("a.p_name").alias("x"), F.col("b.p_name").alias("y")).agg(F.count("*").alias("common"), (F.first("a.n") + F.first("b.n")).alias("n"))
    links = links.select("p_brand", "x", "y", "common", (F.col("n") - F.col("common")).cast("long").alias("either"))
    held = groups.blocks(p, ["p_brand", "p_name"], "p_partkey")
    return groups.expanded(links, held, {"p_brand": "p_brand", "x": "p_name"}, {"p_brand": "p_brand", "y": "p_name"}, F.col("x") == F.col("y")).select("a", "b", "common", "either")


@query("year_tokens", "SELECT doc_id, array_to_string(regexp_extract_all(text, '(公元前?\\s*[0-9]+|[0-9]{3,4})', 1), ',') AS years FROM documents")
def year_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-24."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.year_tokens(F.col("text")), ",").alias("years"))


@query("topic_argmax", """WITH h AS (SELECT doc_id, CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'of') AS INT) + CAST(contains(text, 'and') AS INT) AS a, CAST(contains(text, 'ing') AS INT) + CAST(contains(text, 'tion') AS INT) + CAST(contains(text, 'to') AS INT) AS b,
  CAST(contains(text, 'in') AS INT) + CAST(contains(text, 'at') AS INT) + CAST(contains(text, 'on') AS INT) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a = greatest(a, b, c) THEN 'structure' WHEN b = greatest(a, b, c) THEN 'motion' ELSE 'place' END AS topic FROM h""")
def topic_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25, FN-28."""
    return table(spark, sf_dir, "documents").select("doc_id", text.topic(F.col("text")).alias("topic"))


@query("query_terms", r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[\s,.;:!?，。；：！？、]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'a', 'of', 'and', 'to', 'in', 'is', 'for')) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], ' ') AS terms FROM w""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-35, WN-16: first-seen order."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("claim_sentences", """SELECT conv_id, turn, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?.\\n]'), lambda x: trim(x)), lambda x: length(x) >= 6)) AS BIGINT) AS claims FROM conversations""")
def claim_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-37."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.sentences(F.col("text"))).cast("long").alias("claims"))


@query("ingest_dedupe", """
WITH t AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, CASE WHEN r = 1 THEN 'registered' ELSE 'duplicate_text' END AS status FROM t""")
def ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-1: the first of equal texts is registered; texts travel as digests, counted before the join back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").select("doc_id", F.when(F.col("doc_id") == F.col("first"), "registered").otherwise("duplicate_text").alias("status"))


_DIGITS = "一二三四五六七八九"
#: Chinese numerals of 1 to 99 in SQL, of an expression n.
_NUMERAL = "(CASE WHEN {n} >= 20 THEN substr('" + _DIGITS + "', CAST(floor({n} / 10) AS INT), 1) ELSE '' END || CASE WHEN {n} >= 10 THEN '十' ELSE '' END || CASE WHEN {n} % 10 > 0 THEN substr('" + _DIGITS + "', CAST({n} % 10 AS INT), 1) ELSE '' END)"
_DATED = f"""SELECT CASE o_orderkey % 8 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '年' WHEN 1 THEN '公元前' || CAST(o_custkey % 900 + 1 AS STRING) || '年' WHEN 2 THEN '民国' || {_NUMERAL.format(n="(o_custkey % 37 + 1)")} || '年' WHEN 3 THEN CAST(o_custkey % 10 + 12 AS STRING) || '世纪'
  WHEN 4 THEN '光绪' || {_NUMERAL.format(n="(o_custkey % 34 + 1)")} || '年' WHEN 5 THEN '唐代' WHEN 6 THEN '贞观' || {_NUMERAL.format(n="(o_custkey % 23 + 1)")} || '年' ELSE '编号' END AS raw, o_orderkey % 8 AS k, o_custkey AS c, o_orderdate AS d FROM orders """


@query("calendar_dates", f"""SELECT raw, CAST(CASE k WHEN 0 THEN year(d) WHEN 1 THEN -(c % 900 + 1) WHEN 2 THEN 1911 + c % 37 + 1 WHEN 3 THEN (c % 10 + 11) * 100 WHEN 4 THEN 1874 + c % 34 + 1 WHEN 5 THEN 618 WHEN 6 THEN 626 + c % 23 + 1 END AS INT) AS valid_from,
  CAST(CASE k WHEN 0 THEN year(d) WHEN 1 THEN -(c % 900 + 1) WHEN 2 THEN 1911 + c % 37 + 1 WHEN 3 THEN (c % 10 + 12) * 100 - 1 WHEN 4 THEN 1874 + c % 34 + 1 WHEN 5 THEN 907 WHEN 6 THEN 626 + c % 23 + 1 END AS INT) AS valid_to, CASE k WHEN 2 THEN '民国' WHEN 4 THEN '清' WHEN 5 THEN '唐' WHEN 6 THEN '唐' END AS dynasty,
  count(*) AS n FROM ({_DATED}) x GROUP BY ALL""")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22, FN-39: times written the ways that occur, made of every order's date and customer; each different text is read once."""
    raw = spark.sql(_DATED.replace("FROM orders ", "FROM {orders} AS orders "), orders=table(spark, sf_dir, "orders")).groupBy("raw").agg(F.count("*").alias("n"))
    raw = staged(raw, "calendar")  # the rules are code enough for a stage of their own
    return raw.withColumn("p", calendar.parse(F.col("raw"))).select("raw", "p.valid_from", "p.valid_to", "p.dynasty", "n")


_CALENDAR = ["光绪二十五年", "民国二十七年", "贞观三年", "1984年", "公元前256年", "唐代", "明朝万历年间", "20世纪初", "90年代", "庚子年", "1840年", "南宋绍兴年间", "1927年8月1日"]
_EXPECTED = [(1899, 1899, "清"), (1938, 1938, "民国"), (629, 629, "唐"), (1984, 1984, None), (-256, -256, None), (618, 907, "唐"), (1368, 1644, "明"), (1900, 1999, None), (1900, 1909, None), (1900, 1900, None), (1840, 1840, None), (1127, 1279, "南宋"), (1927, 1927, None)]


@query("calendar_parse", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {a}, {b}, {'NULL' if d is None else repr(d)})" for t, (a, b, d) in zip(_CALENDAR, _EXPECTED, strict=True)) + ") v(raw, valid_from, valid_to, dynasty)")
def calendar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22, FN-39 on the literal cases."""
    p = spark.createDataFrame([(x,) for x in _CALENDAR], "raw string").withColumn("p", calendar.parse(F.col("raw")))
    return p.select("raw", "p.valid_from", "p.valid_to", "p.dynasty")
