"""Gates on names and answers, sufficiency and closure figures, samples, structural gaps, tasks and lookups.

Each query's SQL is written apart from Spark's form.  Judges enter as the table of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, gates, scoring, url
from ..sources import table
from . import query
from .relational import statement

#: Names that reach every branch of the gates, beside the names of the tables.
NAMES = [(-1, "G318 高速公路"), (-2, "湖北"), (-3, "四川省"), (-4, "某某集团"), (-5, "都江堰"), (-6, "app下载"), (-7, "此说存疑，或云异说"), (-8, None), (-9, "上海博物馆"), (-10, "重庆"), (-11, "广西"), (-12, "湖南与湖北")]
_LITERALS = "(VALUES " + ", ".join(f"({i}, {'CAST(NULL AS VARCHAR)' if n is None else repr(n)})" for i, n in NAMES) + ") v(id, name)"
_NAMED = f"SELECT * FROM {_LITERALS} UNION ALL SELECT p_partkey, p_name FROM part UNION ALL SELECT s_suppkey + 1000000000, s_name FROM supplier"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.createDataFrame(NAMES, "id bigint, name string")
    return out.union(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), "p_name")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + F.lit(1_000_000_000).cast("long"), "s_name"))


@query("entity_gate", f"""SELECT n.id, CASE WHEN regexp_matches(coalesce(name, ''), '{gates.HARD_REJECT}', 'i') THEN 'REJECT' WHEN quality = 1 AND toxic = 0 THEN 'KEEP' ELSE 'REJECT' END AS verdict,
  regexp_matches(coalesce(name, ''), '{gates.HARD_REJECT}', 'i') AS hard FROM ({_NAMED}) n LEFT JOIN labels ON doc_id = n.id""")
def entity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-3, FN-29: hard negatives, then the judge's answer; a missing one rejects."""
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "KEEP").otherwise("REJECT").alias("judged"))
    return _names(spark, sf_dir).join(judged, "id", "left").select("id", gates.verdict(F.col("name"), F.col("judged")).alias("verdict"), gates.hard_negative(F.col("name")).alias("hard"))


_PROVINCE_LIST = ", ".join(f"'{p}'" for p in gates.PROVINCES)
# the regions of names, written out once more
_REGION_LIST = "'湖北', '湖南', '四川', '重庆', '江苏', '江西', '安徽', '云南', '贵州', '青海', '西藏', '甘肃', '河南', '陕西', '浙江', '上海'"


@query("name_predicates", f"""SELECT id, trim(coalesce(name, '')) IN ({_PROVINCE_LIST}) OR regexp_matches(trim(coalesce(name, '')), '{gates.PROVINCE_SUFFIX}') AS container,
  regexp_matches(coalesce(name, ''), '{gates.ENTERPRISE}') AS enterprise, regexp_matches(coalesce(name, ''), '{gates.DISPUTE}') AS disputed,
  (SELECT min_by(p, i) FROM (SELECT unnest([{_REGION_LIST}]) AS p, unnest(range(16)) AS i) x WHERE contains(name, p)) AS region FROM ({_NAMED}) n""")
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-26, FN-27, FN-30: province containers, enterprises, disputes, and the first region of the list that a name holds."""
    name = F.coalesce("name", F.lit(""))
    return _names(spark, sf_dir).select("id", gates.province_container(F.col("name")).alias("container"), name.rlike(gates.ENTERPRISE).alias("enterprise"), name.rlike(gates.DISPUTE).alias("disputed"), gates.first_held(F.col("name"), gates.REGIONS).alias("region"))


@query("safe_names", r"""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9._-]', '_', 'g') AS lake,
  CASE WHEN x = '' THEN 'untitled' ELSE x END AS file FROM (SELECT *, trim(left(regexp_replace(url, '[\\/:*?"<>|[:space:]]+', '_', 'g'), 40), '_') AS x FROM pages) p""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-3, FN-4 on the addresses of pages."""
    return table(spark, sf_dir, "pages").select("page_id", url.lake_safe(F.col("url")).alias("lake"), url.safe_name(F.col("url")).alias("file"))


@query("norm_keys", r"""SELECT conv_id, turn, left(regexp_replace(coalesce(text, ''), '[[:space:]，。、；：？！"''（）()\[\]【】《》<>—\-…·,.:;?!]+', '', 'g'), 120) AS key FROM conversations""")
def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-18."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.norm_key(F.col("text")).alias("key"))


@query("field_pieces", """SELECT doc_id, len(p) AS n, p[1] AS head, p[2] AS second FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[、,，;；]'), lambda x: trim(x)), lambda x: x <> '')[1:20] AS p FROM documents) d""")
def field_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-34: the enumerated parts of a text."""
    p = gates.pieces(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).cast("long").alias("n"), F.get(p, F.lit(0)).alias("head"), F.get(p, F.lit(1)).alias("second"))


_RAW = [(-1, "abc"), (-2, "1.7"), (-3, "-3"), (-4, None), (-5, "0.25")]
_RAW_SQL = "(VALUES " + ", ".join(f"({i}, {'CAST(NULL AS VARCHAR)' if x is None else repr(x)})" for i, x in _RAW) + ") v(id, raw)"


@query("answer_scores", f"""SELECT id, CASE WHEN s IS NULL OR s < 0 THEN 0.0 WHEN s > 1 THEN 1.0 ELSE s END AS score FROM (
  SELECT id, TRY_CAST(raw AS DOUBLE) AS s FROM (SELECT * FROM {_RAW_SQL} UNION ALL SELECT event_id, CAST(value / 300 AS VARCHAR) FROM events) r) t""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-32: scores of a judge's answers as texts, between 0 and 1."""
    raw = spark.createDataFrame(_RAW, "id bigint, raw string").union(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 300).cast("string")))
    return raw.select("id", gates.unit_score(F.col("raw")).alias("score"))


@query("period_axis", f"""SELECT year, CASE WHEN year > 220 AND year < 266 THEN '秦汉' ELSE (SELECT min_by(p, i) FROM (VALUES {", ".join(f"({i}, '{n}', {calendar.PERIODS[n][0]}, {calendar.PERIODS[n][1]})" for i, n in enumerate(calendar.AXIS))}) a(i, p, lo, hi)
  WHERE year BETWEEN lo AND hi) END AS period, n FROM (SELECT CAST(year AS INT) AS year, count(*) AS n FROM (
  SELECT year(o_orderdate) AS year FROM orders UNION ALL SELECT l_partkey % 2300 - 300 FROM lineitem) y GROUP BY 1) z""")
def period_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-23: the period of each year, over order dates and years made from part keys."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).union(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 2300 - 300).cast("int")))
    return years.groupBy("year").agg(F.count("*").alias("n")).select("year", calendar.period_of_year(F.col("year")).alias("period"), "n")


_LEVELS = [("1-URGENT", "S", 1.0), ("2-HIGH", "A", 0.85), ("3-MEDIUM", "B", 0.6), ("4-NOT SPECIFIED", None, 0.6), ("5-LOW", "C", 0.4)]


@query("authority_weights", "SELECT o_custkey AS source, CAST(sum(CASE left(o_orderpriority, 1) WHEN '1' THEN 100 WHEN '2' THEN 85 WHEN '5' THEN 40 ELSE 60 END) AS BIGINT) AS weight FROM orders GROUP BY o_custkey")
def authority_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-8: weights of a source's statements in hundredths, so that their sum is exact."""
    level = F.coalesce(*(F.when(F.col("o_orderpriority") == p, F.lit(a)) for p, a, _ in _LEVELS))
    weight = F.round(100 * scoring.authority_weight(level)).cast("long")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.sum(weight).alias("weight"))


@query("jsonable_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, o_totalprice = floor(o_totalprice) AS whole FROM orders")
def jsonable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-33: keys and times as texts, and whether a number is written without a fraction."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), (price % 1 == 0).alias("whole"))


#: Pages asked for: clamped to a page of 1 at least and 1 to 200 items.
ASKED = [(1, 1, 20), (2, 0, -5), (3, 999, 999), (4, 2, 7)]


@query("paged_suppliers", f"""SELECT ask, page, size, total, s_suppkey FROM (SELECT ask, greatest(page, 1) AS page, least(greatest(size, 1), 200) AS size FROM (VALUES {", ".join(map(str, ASKED))}) v(ask, page, size)) a
  CROSS JOIN (SELECT count(*) AS total FROM supplier) t LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS n FROM supplier) s ON n > (page - 1) * size AND n <= page * size""")
def paged_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-38, WN-14: pages of the supplier list with the total; each page is an ordered top-k, none needs all rows in one task."""
    suppliers, out = table(spark, sf_dir, "supplier"), None
    for ask, page, size in ASKED:
        page, size = max(page, 1), min(max(size, 1), 200)
        rows = suppliers.orderBy("s_name", "s_suppkey").offset((page - 1) * size).limit(size).select(F.lit(ask).alias("ask"), "s_suppkey")
        head = suppliers.agg(F.count("*").alias("total")).select(F.lit(ask).alias("ask"), F.lit(page).alias("page"), F.lit(size).alias("size"), "total")
        one = head.join(rows, "ask", "left").select("ask", "page", "size", "total", "s_suppkey")
        out = one if out is None else out.union(one)
    return out


# JN-8: the target of a row by its kind; equi-joins keyed by (kind, id) against one side, the oracle joins each kind
statement("polymorphic_targets", """SELECT kind, name, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'SUPPLIER' WHEN 'R' THEN 'PART' ELSE 'OTHER' END AS kind, CASE l_returnflag WHEN 'A' THEN l_suppkey ELSE l_partkey END AS id FROM lineitem) x
  LEFT JOIN (SELECT 'SUPPLIER' AS k, s_suppkey AS i, s_name AS name FROM supplier UNION ALL SELECT 'PART', p_partkey, p_name FROM part) t ON k = kind AND i = id GROUP BY kind, name""",
  """SELECT kind, name, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'SUPPLIER' WHEN 'R' THEN 'PART' ELSE 'OTHER' END AS kind, coalesce(s_name, p_name) AS name FROM lineitem
  LEFT JOIN supplier ON l_returnflag = 'A' AND s_suppkey = l_suppkey LEFT JOIN part ON l_returnflag = 'R' AND p_partkey = l_partkey) x GROUP BY kind, name""")
# JN-14: a map in which the first of equal keys wins
statement("first_owner", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha2(coalesce(text, ''), 256)) AS owner FROM documents",
  "SELECT d.doc_id, m.doc_id AS owner FROM documents d JOIN (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1) m ON coalesce(m.text, '') = coalesce(d.text, '')")

FIELDS = {"time": ["year", "19", "20"], "carriers": ["the ", "la "], "outcomes": ["§§"]}
TERMS = ["the", "und", "para", "pour", "of", "absent"]
_YEAR = "([0-9]{3,4})"


@query("bundle_sufficiency", f"""WITH q AS (SELECT lang AS seed, doc_id, coalesce(text, '') AS quote, coalesce(source, 'res:' || doc_id) AS cluster, CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'C' ELSE 'UNKNOWN' END AS level FROM documents LEFT JOIN labels USING (doc_id)),
y AS (SELECT seed, min(CAST(regexp_extract(quote, '{_YEAR}', 1) AS INT)) AS lo, max(CAST(regexp_extract(quote, '{_YEAR}', 1) AS INT)) AS hi FROM q WHERE regexp_matches(quote, '{_YEAR}') GROUP BY seed),
f AS (SELECT q.seed, field, bool_or(contains(quote, hint)) AS met FROM q CROSS JOIN (VALUES {", ".join(f"('{k}', '{h}')" for k, hs in FIELDS.items() for h in hs)}) h(field, hint) GROUP BY q.seed, field),
p AS (SELECT DISTINCT seed, term FROM q JOIN (VALUES {", ".join(f"('{t}')" for t in TERMS)}) t(term) ON contains(quote, term)),
l AS (SELECT seed, list(level || '=' || n ORDER BY level) AS authority FROM (SELECT seed, level, count(*) AS n FROM q GROUP BY seed, level) x GROUP BY seed)
SELECT seed, (SELECT round(avg(CAST(met AS INT)), 3) FROM f WHERE f.seed IS NOT DISTINCT FROM q.seed) AS ratio, count(DISTINCT cluster) AS independent, (SELECT authority FROM l WHERE l.seed IS NOT DISTINCT FROM q.seed) AS authority,
  (SELECT lo FROM y WHERE y.seed IS NOT DISTINCT FROM q.seed) AS first_year, (SELECT hi FROM y WHERE y.seed IS NOT DISTINCT FROM q.seed) AS last_year,
  (SELECT coalesce(list(term ORDER BY term), [])[1:12] FROM p WHERE p.seed IS NOT DISTINCT FROM q.seed) AS places, count(*) FILTER (regexp_matches(quote, '{gates.DISPUTE}')) AS disputes FROM q GROUP BY seed""")
def bundle_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19: what the quotes of each seed (a language) cover, in one aggregate a seed with partial sums."""
    judged = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("C").alias("level")).dropDuplicates(["doc_id"])
    q = table(spark, sf_dir, "documents").join(judged, "doc_id", "left").select(F.col("lang").alias("seed"), F.coalesce("text", F.lit("")).alias("quote"), F.coalesce("source", F.concat(F.lit("res:"), F.col("doc_id"))).alias("cluster"), F.coalesce("level", F.lit("UNKNOWN")).alias("level"))
    holds = lambda t: F.contains("quote", F.lit(t))
    year = F.when(F.col("quote").rlike(_YEAR), F.regexp_extract("quote", _YEAR, 1).cast("int"))
    fields = [F.max(sum((holds(h).cast("int") for h in hs), F.lit(0)) > 0).cast("int").alias(f"_{k}") for k, hs in FIELDS.items()]
    levels = [F.count(F.when(F.col("level") == x, 1)).alias(f"_{x}") for x in ("A", "C", "UNKNOWN")]
    terms = [F.max(holds(t)).alias(f"_has_{t}") for t in TERMS]
    one = q.groupBy("seed", "cluster").agg(*fields, *levels, *terms, F.min(year).alias("lo"), F.max(year).alias("hi"), F.count(F.when(F.col("quote").rlike(gates.DISPUTE), 1)).alias("disputes"))
    n = lambda x: F.sum(f"_{x}").cast("string")
    listed = F.filter(F.array(*(F.when(F.sum(f"_{x}") > 0, F.concat(F.lit(f"{x}="), n(x))) for x in ("A", "C", "UNKNOWN"))), lambda v: v.isNotNull())
    places = F.filter(F.array(*(F.when(F.max(f"_has_{t}"), F.lit(t)) for t in sorted(TERMS))), lambda v: v.isNotNull())
    ratio = F.round(sum((F.max(f"_{k}") for k in FIELDS), F.lit(0)) / len(FIELDS), 3)
    return one.groupBy("seed").agg(ratio.alias("ratio"), F.count("cluster").alias("independent"), listed.alias("authority"), F.min("lo").alias("first_year"), F.max("hi").alias("last_year"), F.slice(places, 1, 12).alias("places"), F.sum("disputes").alias("disputes"))


# AG-27: the components that each case (a nation) needs, those that are there, and the gate of 95 %
_NEED = "SELECT n_nationkey AS c, b.p_brand FROM nation CROSS JOIN (SELECT DISTINCT p_brand FROM part) b"
statement("case_coverage", f"""SELECT c AS golden, sum(CASE WHEN k IS NULL THEN 0 ELSE 1 END) AS met, count(*) AS needed, 100 * sum(CASE WHEN k IS NULL THEN 0 ELSE 1 END) >= 95 * count(*) AS ok
  FROM ({_NEED}) r LEFT JOIN (SELECT DISTINCT s_nationkey AS k, p.p_brand AS brand FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('A', 'R')) h ON k = c AND brand = p_brand GROUP BY c""",
  f"""SELECT c AS golden, count(*) FILTER (met) AS met, count(*) AS needed, count(*) FILTER (met) / count(*) >= 0.95 AS ok FROM (
  SELECT c, EXISTS (SELECT 1 FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('A', 'R') AND s_nationkey = r.c AND p.p_brand = r.p_brand) AS met FROM ({_NEED}) r) x GROUP BY c""")
# AG-28 without relocation: how many lines still have their resource, subject and object
statement("closure_rates", """SELECT count(*) AS rows_in, count(o_orderkey) AS resources, count(p_partkey) AS subjects, count(s_suppkey) AS objects, round(count(o_orderkey) / count(*), 6) AS rate
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""",
  """SELECT (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS resources, (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)) AS subjects,
  (SELECT count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)) AS objects, (SELECT round(avg(CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN 1.0 ELSE 0.0 END), 6) FROM lineitem) AS rate""")
# AG-29: counts by category against the counts that the benchmark's rules ask for
_EXPECTED = "(VALUES ('view', 200), ('click', 210), ('refund', 1)) e(kind, want)"
statement("category_counts", f"SELECT coalesce(event_type, kind) AS category, count(event_type) AS n, max(want) AS want, count(event_type) = max(want) AS ok FROM events FULL JOIN {_EXPECTED} ON kind = event_type GROUP BY coalesce(event_type, kind)",
  f"SELECT c.k AS category, (SELECT count(*) FROM events WHERE event_type = c.k) AS n, want, (SELECT count(*) FROM events WHERE event_type = c.k) = want AS ok FROM (SELECT event_type AS k FROM events UNION SELECT kind FROM {_EXPECTED}) c LEFT JOIN {_EXPECTED} ON kind = c.k")

# WN-4: the best order of each customer, where it is good enough
statement("best_match", "SELECT o_custkey, -x.k AS best FROM (SELECT o_custkey, max(struct(o_totalprice AS p, -o_orderkey AS k)) AS x FROM orders GROUP BY o_custkey) g WHERE x.p >= 150000",
  "SELECT o_custkey, o_orderkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) o WHERE n = 1 AND o_totalprice >= 150000")


@query("stratified_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) AS n FROM events) e WHERE n <= 80")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-9: up to 80 events of each type in the order of a seeded hash; a rank limit a partition comes before the shuffle."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string"))), "event_id"))
    return table(spark, sf_dir, "events").withColumn("n", n).where(F.col("n") <= 80).select("event_type", "event_id")


# WN-15: the order of an outside list, unknown names last and by name
statement("listed_order", "SELECT n_name, row_number() OVER (ORDER BY coalesce(pos, 1000), n_name) AS place FROM nation LEFT JOIN (VALUES ('NATION_7', 0), ('NATION_2', 1), ('NATION_19', 2)) s(name, pos) ON name = n_name",
  "SELECT n_name, (SELECT count(*) FROM nation y WHERE (coalesce(list_position(['NATION_7', 'NATION_2', 'NATION_19'], y.n_name), 1000), y.n_name) <= (coalesce(list_position(['NATION_7', 'NATION_2', 'NATION_19'], x.n_name), 1000), x.n_name)) AS place FROM nation x")
# RT-15: edges from each phase (a year) of a system (a brand) to the next
_PHASES = "SELECT DISTINCT p_brand AS brand, year(l_shipdate) AS y FROM lineitem JOIN part ON p_partkey = l_partkey"
statement("phase_chain", f"SELECT * FROM (SELECT brand, lag(y) OVER (PARTITION BY brand ORDER BY y) AS previous, y AS next FROM ({_PHASES}) p) q WHERE previous IS NOT NULL",
  f"WITH p AS ({_PHASES}) SELECT a.brand, a.y AS previous, min(b.y) AS next FROM p a JOIN p b ON b.brand = a.brand AND b.y > a.y GROUP BY a.brand, a.y")
# RT-16: a name is looked up as it is, then as an alias, then inside longer names; the path leads to the root
_ASKED = "(VALUES (1, 'Supplier#000000003'), (2, 'sup 5'), (3, '00000007'), (4, 'nobody')) a(ask, term)"
_ALIAS = "(VALUES ('sup 5', 5), ('sup 5', 8)) z(alias, id)"
statement("why_path", f"""SELECT ask, x.step AS step, s_name AS entity, concat_ws(' > ', s_name, n_name, r_name, 'root') AS path FROM (
  SELECT ask, min(struct(step, k)) AS x FROM (SELECT ask, 1 AS step, s_suppkey AS k FROM {_ASKED} JOIN supplier ON s_name = term UNION ALL SELECT ask, 2, id FROM {_ASKED} JOIN {_ALIAS} ON alias = term
    UNION ALL SELECT ask, 3, s_suppkey FROM {_ASKED} JOIN supplier ON contains(s_name, term)) f GROUP BY ask) g
  JOIN supplier ON s_suppkey = x.k JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
  f"""SELECT ask, step, s_name AS entity, s_name || ' > ' || n_name || ' > ' || r_name || ' > root' AS path FROM (
  SELECT ask, coalesce(e, l, c) AS k, CASE WHEN e IS NOT NULL THEN 1 WHEN l IS NOT NULL THEN 2 ELSE 3 END AS step FROM (SELECT ask, (SELECT min(s_suppkey) FROM supplier WHERE s_name = term) AS e,
    (SELECT min(id) FROM {_ALIAS} WHERE alias = term) AS l, (SELECT min(s_suppkey) FROM supplier WHERE s_name LIKE '%' || term || '%') AS c FROM {_ASKED}) x) y
  JOIN supplier ON s_suppkey = k JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
