"""What comes in: results of searches, routes of fetching, pages of documents, events, interpretations.

Connectors are inputs: their results are tables here, and the rules that sort them are queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission
from ..sources import table
from . import query
from .validation import made

TOP = 5
# Endings that aren't fetched, and hosts that refuse.
SKIPPED = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".mp3", ".mp4", ".avi", ".wmv", ".flv", ".exe", ".apk", ".iso"]
BLOCKED = ["baike.baidu.com", "zhihu.com", "zhuanlan.zhihu.com", "wenku.baidu.com", "zhidao.baidu.com", "baijiahao.baidu.com", "xueqiu.com", "docs.qq.com"]
#: Addresses that reach every route.
URLS = [(-1, "https://a.org/x.PDF"), (-2, "https://a.org/pic.jpg"), (-3, "http://www.zhihu.com/q/1"), (-4, "ftp://a.org/x"), (-5, "https://a.org/notes.txt"), (-6, "https://a.org/page/"), (-7, "HTTPS://A.org/page"), (-8, None)]
_URLS = "(VALUES " + ", ".join(f"({i}, {'CAST(NULL AS VARCHAR)' if u is None else repr(u)})" for i, u in URLS) + ") v(page_id, url)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url").union(spark.createDataFrame(URLS, "page_id long, url string"))


@query("search_results", f"""WITH p AS (SELECT page_id, url, abs(page_id) % 20 AS q FROM (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {_URLS} UNION ALL SELECT page_id + 1000000, upper(url) || '/' FROM pages) u WHERE regexp_matches(lower(coalesce(url, '')), '^https?://')),
d AS (SELECT *, row_number() OVER (PARTITION BY q, lower(rtrim(url, '/')) ORDER BY page_id) AS k FROM p) SELECT q, page_id, url, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY page_id) AS r FROM d WHERE k = 1) x WHERE r <= {TOP}""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: of each query the first results in the engine's order, an address once whatever its case and last slash."""
    pages = _pages(spark, sf_dir)
    again = table(spark, sf_dir, "pages").select(F.col("page_id") + 1000000, F.concat(F.upper("url"), F.lit("/")))
    rows = pages.union(again).where(F.lower("url").rlike("^https?://")).withColumn("q", F.abs("page_id") % 20)
    kept = rows.groupBy("q", F.lower(F.rtrim("url", F.lit("/"))).alias("key")).agg(F.min(F.struct("page_id", "url")).alias("x")).select("q", "x.*")
    return spark.sql(f"SELECT q, page_id, url, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY page_id) AS r FROM {{rows}}) t WHERE r <= {TOP}", rows=kept)


@query("fetch_routes", f"""SELECT page_id, CASE WHEN url IS NULL OR NOT regexp_matches(lower(url), '^https?://') THEN 'skip' WHEN {" OR ".join(f"suffix(lower(url), '{x}')" for x in SKIPPED)} THEN 'skip' WHEN {" OR ".join(f"contains(lower(url), '{x}')" for x in BLOCKED)} THEN 'blocked'
  WHEN suffix(lower(url), '.pdf') THEN 'pdf' WHEN suffix(lower(url), '.txt') THEN 'text' ELSE 'html' END AS route FROM (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {_URLS}) u""")
def fetch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: which way an address is fetched, if it is."""
    u = F.lower(F.coalesce("url", F.lit("")))
    ends = u.rlike("(" + "|".join(x.replace(".", r"\.") for x in SKIPPED) + ")$")
    route = F.when(~u.rlike("^https?://") | ends, "skip").when(u.rlike("|".join(x.replace(".", r"\.") for x in BLOCKED)), "blocked").when(u.endswith(".pdf"), "pdf").when(u.endswith(".txt"), "text").otherwise("html")
    return _pages(spark, sf_dir).select("page_id", route.alias("route"))


@query("encyclopedia_extracts", "SELECT lang, doc_id, CAST(r AS INT) AS r FROM (SELECT coalesce(lang, '?') AS lang, doc_id, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 300) x WHERE r <= 5")
def encyclopedia_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: extracts of 300 characters and more, the first of each query (language)."""
    rows = table(spark, sf_dir, "documents").where(F.length("text") >= 300).select(F.coalesce("lang", F.lit("?")).alias("lang"), "doc_id")
    return spark.sql(f"SELECT lang, doc_id, r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM {{rows}}) t WHERE r <= {TOP}", rows=rows)


@query("paged_texts", "SELECT doc_id, CAST(i - 1 AS INT) AS page, length(p[i]) AS chars, len(p) AS pages FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(12)), chr(12)) AS p FROM documents WHERE text IS NOT NULL) d, range(1, 100000) t(i) WHERE i <= len(p)")
def paged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: texts cut at form feeds (put where sentences end), page by page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.replace("text", F.lit(". "), F.lit(".\f")), "\f").alias("p"))
    return d.select("doc_id", F.posexplode("p").alias("page", "x"), F.size("p").cast("long").alias("pages")).select("doc_id", "page", F.length("x").cast("long").alias("chars"), "pages")


@query("empty_arrays", "SELECT s_suppkey, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R') AS routes FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R' AND l_discount > 0.09)")
def empty_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FL-8: suppliers whose array of deep discounts is missing or empty, with the size of another."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R'").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("routes"), F.collect_set(F.when(F.col("l_discount") > 0.09, F.col("l_partkey"))).alias("deep"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.where(F.coalesce(F.size("deep"), F.lit(0)) <= 0).select("s_suppkey", F.greatest(F.coalesce(F.size("routes"), F.lit(0)), F.lit(0)).cast("long").alias("routes"))


_EVENTS = """SELECT o_orderkey AS id, CASE WHEN o_custkey % 17 > 0 THEN 'event ' || CAST(o_custkey % 400 AS STRING) ELSE ' ' END AS name, left(o_orderpriority, 1) AS type, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey END AS entity,
  CASE WHEN o_orderkey % 7 > 1 THEN CAST(year(o_orderdate) AS STRING) END AS time_text, CASE WHEN o_orderkey % 7 = 1 THEN 'a period' END AS period, CASE WHEN o_orderkey % 11 > 0 THEN n_name END AS place, coalesce(n, 0) AS participants,
  'event ' || CAST(o_custkey % 400 AS STRING) AS quote, CASE WHEN o_orderkey % 19 > 1 THEN 'it says event ' || CAST(o_custkey % 400 AS STRING) || '.' WHEN o_orderkey % 19 = 1 THEN 'event，' || CAST(o_custkey % 400 AS STRING) END AS chunk, CASE o_orderstatus WHEN 'F' THEN 'CORE' WHEN 'O' THEN 'CONTEXT' END AS scope
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""


@query("event_gate", f"""WITH e AS ({_EVENTS}), b AS (SELECT *, CASE WHEN contains(chunk, quote) THEN 'EXACT' WHEN contains(replace(replace(chunk, '，', ''), ' ', ''), replace(quote, ' ', '')) AND length(replace(quote, ' ', '')) >= 6 THEN 'NORMALIZED' ELSE 'FAILED' END AS match FROM e),
f AS (SELECT *, CASE WHEN trim(name) = '' THEN 0 WHEN entity IS NULL THEN 1 WHEN time_text IS NULL AND period IS NULL THEN 2 WHEN place IS NULL THEN 3 WHEN participants = 0 THEN 4 WHEN match = 'FAILED' THEN 5 WHEN scope IS NULL THEN 6 END AS failed FROM b),
w AS (SELECT *, min(id) FILTER (failed IS NULL) OVER (PARTITION BY name, type) AS first FROM f)
SELECT id, CASE WHEN failed IS NOT NULL THEN 'REJECTED' WHEN id > first THEN 'CONTESTED' ELSE 'ADMITTED' END AS status, [{", ".join(f"'{s}'" for s in admission.EVENT_STAGES)}][failed + 1] AS failed_stage, match, CASE WHEN failed IS NULL AND id > first THEN first END AS conflict_with FROM w""")
def event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-5: the nine stages of events, here orders; one event of a name and type is admitted."""
    return admission.admit_events(made(spark, sf_dir, _EVENTS))


@query("synthesis_ready", "SELECT s_nationkey AS seed, count(DISTINCT l_orderkey) AS resources, CASE WHEN count(DISTINCT l_orderkey) >= 2 THEN 'JUDGE' ELSE 'SKIP' END AS decision FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07) l ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def synthesis_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-16: seeds with under two distinct resources are skipped before a judge is asked."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07").select("l_suppkey", "l_orderkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("s_nationkey", "l_orderkey").agg(F.lit(1).alias("one"))
    return rows.groupBy(F.col("s_nationkey").alias("seed")).agg(F.count("l_orderkey").alias("resources")).select("seed", "resources", F.when(F.col("resources") >= 2, "JUDGE").otherwise("SKIP").alias("decision"))


@query("interpretation_import", """WITH s AS (SELECT min(c_custkey) AS id, trim(c_mktsegment) AS statement, c_nationkey AS subject FROM customer WHERE trim(coalesce(c_mktsegment, '')) <> '' GROUP BY 2, 3),
n AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey % 10 = 0 AND c.c_acctbal > 5000 AND trim(c.c_mktsegment) = statement AND c.c_nationkey = subject))
SELECT id, statement, subject, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_nationkey = subject) AS evidence FROM n""")
def interpretation_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-17: statements on subjects that aren't stored yet (stored are those of every tenth rich customer), once each, with the evidence copied to them."""
    said = table(spark, sf_dir, "customer").select("c_custkey", F.trim(F.coalesce("c_mktsegment", F.lit(""))).alias("statement"), F.col("c_nationkey").alias("subject"), "c_acctbal").where("statement <> ''")
    stored = said.where("c_custkey % 10 = 0 AND c_acctbal > 5000").select(F.col("statement").alias("_s"), F.col("subject").alias("_n")).distinct()
    new = said.groupBy("statement", "subject").agg(F.min("c_custkey").alias("id")).join(stored, (F.col("statement") == F.col("_s")) & F.col("subject").eqNullSafe(F.col("_n")), "left_anti")
    evidence = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("_k")).agg(F.countDistinct("s_suppkey").alias("evidence"))
    return new.join(evidence, F.col("subject") == F.col("_k"), "left").select("id", "statement", "subject", F.coalesce("evidence", F.lit(0)).alias("evidence"))
