"""Verdicts of judges, gates, vocabulary checks, provenance chains and relocation, over the tables.

The inputs that the tables don't hold as such (votes, gold answers, chunk ids) are made of their columns by
statements that both engines run; the rules are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import benchmarks as M
from ..operators import lint as L
from ..sources import TABLES, table
from . import query


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables, run by Spark."""
    used = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} AS {t} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


# three runs of a judge on each customer, and what is expected
_VOTES = """SELECT o_custkey AS case, run, CASE o_orderkey % 9 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'CANDIDATE' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'S0' ELSE CASE WHEN c_custkey % 4 = 0 THEN 'REJECT' WHEN c_custkey % 4 = 1 THEN 'CANDIDATE' ELSE 'S' || CAST(c_nationkey % 3 AS STRING) END END AS vote
  FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders ) o JOIN customer ON c_custkey = o_custkey WHERE run <= 3"""
_CASES = """SELECT c_custkey AS case, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'border' ELSE lower(c_mktsegment) END AS family, CASE c_custkey % 4 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'CANDIDATE' ELSE 'ADMIT' END AS expected, 'S' || CAST(c_nationkey % 3 AS STRING) AS system,
  CASE WHEN c_custkey % 5 = 0 THEN 'CANDIDATE' WHEN c_custkey % 5 = 1 THEN 'S0' END AS also, c_custkey % 6 = 2 AS several, CASE WHEN c_acctbal > 0 THEN 'ADMITTED' ELSE 'CANDIDATE' END AS rule, CASE WHEN c_custkey % 3 = 0 THEN 'injected' ELSE 'real' END AS kind FROM customer """


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = made(spark, sf_dir, _CASES).withColumn("accept", F.when(F.col("also").isNotNull(), F.array("also"))).withColumn("systems", F.when(F.col("several"), F.array(F.lit("S1"), F.lit("S2"))))
    return M.graded(cases, M.majority(made(spark, sf_dir, _VOTES)))


_BALLOTS = f"""v AS ({_VOTES}), m AS (SELECT "case", arg_min(vote, (-n, f, vote)) AS verdict FROM (SELECT "case", vote, count(*) AS n, min(run) AS f FROM v WHERE vote <> 'ERROR' GROUP BY ALL) GROUP BY "case"),
g AS MATERIALIZED (SELECT c.*, coalesce(m.verdict, 'ERROR') AS verdict FROM ({_CASES}) c LEFT JOIN m ON m."case" = c."case"),
k AS MATERIALIZED (SELECT *, verdict IN ('S0', 'S1', 'S2') AS admit, CASE WHEN verdict = 'ERROR' THEN false WHEN expected <> 'ADMIT' THEN verdict NOT IN ('S0', 'S1', 'S2') WHEN verdict = 'CANDIDATE' THEN several OR coalesce(also = 'CANDIDATE', false)
  WHEN verdict = 'REJECT' THEN false WHEN several THEN verdict IN ('S1', 'S2') ELSE verdict = system OR coalesce(also = verdict, false) END AS ok FROM g)""".replace("AS case,", 'AS "case",')


@query("judge_votes", f'WITH {_BALLOTS} SELECT "case", verdict, ok FROM k')
def judge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21: the majority of three runs, and whether it is right."""
    return _graded(spark, sf_dir).select("case", "verdict", "ok")


@query("judge_scores", f"""WITH {_BALLOTS}, n AS (SELECT count(*) AS cases, count(*) FILTER (verdict = 'ERROR') AS errors, count(*) FILTER (expected = 'ADMIT' AND ok) AS tp, count(*) FILTER (expected <> 'ADMIT' AND admit) AS fp,
  count(*) FILTER (expected = 'ADMIT' AND NOT ok AND verdict <> 'ERROR') AS fn, count(*) FILTER (expected <> 'ADMIT' AND NOT admit AND verdict <> 'ERROR') AS tn, count(*) FILTER (expected = 'CANDIDATE' AND verdict = 'CANDIDATE') / greatest(1, count(*) FILTER (family = 'border')) AS b FROM k),
r AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS c FROM n) SELECT cases, errors, tp, fp, fn, tn, round(p, 4) AS precision, round(c, 4) AS recall, round(2 * p * c / greatest(1e-9, p + c), 4) AS f1, round(b, 4) AS border_honesty,
  CASE WHEN p >= 0.97 AND c >= 0.9 AND 2 * p * c / greatest(1e-9, p + c) >= 0.93 THEN 'PASS' ELSE 'FAIL' END AS gate FROM r""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21: precision, recall, F1, honesty on border cases and the gate."""
    return M.scores(_graded(spark, sf_dir))


@query("judge_families", f"WITH {_BALLOTS} SELECT family, count(*) AS total, count(*) FILTER (ok) AS ok, round(count(*) FILTER (ok) / count(*), 4) AS rate FROM k GROUP BY family")
def judge_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21: right answers by family."""
    return M.families(_graded(spark, sf_dir))


@query("judge_agreement", f"""WITH {_BALLOTS}, n AS (SELECT count(*) FILTER (rule = 'ADMITTED') AS admitted, count(*) FILTER (rule = 'ADMITTED' AND admit) AS upheld, count(*) FILTER (rule <> 'ADMITTED') AS candidates,
  count(*) FILTER (rule <> 'ADMITTED' AND verdict IN ('CANDIDATE', 'REJECT')) AS l, count(*) FILTER (verdict = 'ERROR') AS errors FROM k)
SELECT admitted, upheld, round(upheld / admitted, 4) AS admitted_precision, candidates, l AS "left", round(l / candidates, 4) AS candidate_uphold, errors FROM n""")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-22: how far a judge upholds the rule's decisions."""
    return M.agreement(_graded(spark, sf_dir))


_TRUE = "CASE WHEN verdict = 'ERROR' THEN 'ERROR' WHEN {admit} THEN 'TRUE' ELSE 'FALSE' END"


@query("gap_precision", f"""WITH {_BALLOTS}, t AS (SELECT kind, {_TRUE.format(admit="admit")} AS v FROM k), n AS (SELECT count(*) AS total, count(*) FILTER (kind = 'real' AND v = 'TRUE') AS real_true, count(*) FILTER (kind <> 'real' AND v = 'FALSE') AS injected_rejected, count(*) FILTER (v = 'ERROR') AS errors FROM t)
SELECT *, round((real_true + injected_rejected) / total, 4) AS gap_precision, CASE WHEN (real_true + injected_rejected) / total >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS gate FROM n""")
def gap_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-23: real and injected gaps judged rightly."""
    return M.gap_precision(_graded(spark, sf_dir).select("kind", F.expr(_TRUE.format(admit="admit")).alias("verdict")))


_SCOPES = "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'CORE' WHEN quality = 1 THEN 'CONTEXT' ELSE 'REJECT' END AS expected, CASE WHEN lang IS NULL THEN NULL WHEN n_chars < 300 THEN 'REJECT' WHEN toxic = 1 THEN 'CONTEXT' ELSE 'CORE' END AS got FROM labels JOIN documents ON documents.doc_id = labels.doc_id"


@query("scope_accuracy", f"""WITH s AS ({_SCOPES}), n AS (SELECT count(*) AS cases, count(*) FILTER (expected = coalesce(got, 'REJECT')) AS r, count(*) FILTER (expected = 'REJECT' AND coalesce(got, 'REJECT') <> 'REJECT') AS w FROM s)
SELECT cases, round(r / cases, 3) AS accuracy, round(w / cases, 3) AS false_accept_rate, CASE WHEN r / cases >= 0.95 AND w / cases <= 0.05 THEN 'PASS' ELSE 'FAIL' END AS gate FROM n""")
def scope_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-24: a scope rule on lengths against the labels."""
    return M.scope_accuracy(made(spark, sf_dir, _SCOPES + " "))


#: gate, sample, violations, least sample, capability absent; each is one count over its tables.
_METRICS = [
    ("G01_LINES_HAVE_ORDERS", "SELECT count(*) AS sample, count(CASE WHEN o_orderkey IS NULL THEN 1 END) AS violations FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey ", 30, "false"),
    ("G02_BALANCES", "SELECT count(*) AS sample, count(CASE WHEN s_acctbal < 0 THEN 1 END) AS violations FROM supplier ", 30, "false"),
    ("G03_NAMED_PARTS", "SELECT count(*) AS sample, count(CASE WHEN trim(coalesce(p_name, '')) = '' THEN 1 END) AS violations FROM part ", 30, "false"),
    ("G04_REGISTERED_PREDICATES", "SELECT count(*) AS sample, count(CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 1 END) AS violations FROM lineitem ", 1, "false"),
    ("G05_ORDERS_HAVE_EVIDENCE", "SELECT count(*) AS sample, count(CASE WHEN n IS NULL THEN 1 END) AS violations FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey) e ON k = o_orderkey ", 1, "false"),
    ("G06_HIGH_RISK_SUPPORT", "SELECT count(*) AS sample, count(CASE WHEN independent < 2 THEN 1 END) AS violations FROM (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS independent FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey) s ", 1, "false"),
    ("G07_REGIONS", "SELECT count(*) AS sample, 0 AS violations FROM region ", 30, "false"),
    ("G08_LABELS_HAVE_DOCUMENTS", "SELECT count(*) AS sample, count(CASE WHEN documents.doc_id IS NULL THEN 1 END) AS violations FROM labels LEFT JOIN documents ON documents.doc_id = labels.doc_id ", 30, "false"),
    ("G09_RETURNED_WEIGHTS", "SELECT count(*) AS sample, 0 AS violations FROM lineitem WHERE l_quantity < 0 ", 30, "true"),
    ("G10_BENCHMARK_TEXTS", "SELECT count(*) AS sample, count(CASE WHEN length(text) < 20 THEN 1 END) AS violations FROM benchmark ", 10, "false"),
]
_GATES = " UNION ALL ".join(f"SELECT '{g}' AS gate, CAST(sample AS BIGINT) AS sample, CAST(violations AS BIGINT) AS violations, {least} AS least, {absent} AS absent FROM ({sql}) x{i}" for i, (g, sql, least, absent) in enumerate(_METRICS))
_DECIDED = f"SELECT gate, sample, violations, CASE WHEN absent AND sample = 0 THEN 'FAIL_CAPABILITY_ABSENT' WHEN sample < least THEN 'NOT_MEASURED' WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({_GATES}) m"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = made(spark, sf_dir, _GATES)
    return m.select("gate", "sample", "violations", scoring.gate(F.col("sample"), F.col("violations"), F.col("least"), F.col("absent") & (F.col("sample") == 0)).alias("status"))


@query("gate_report", _DECIDED)
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VG-1, VG-2, VG-4: ten gates with their samples and violations."""
    return _decided(spark, sf_dir)


@query("release_overall", f"""WITH d AS ({_DECIDED}) SELECT CASE WHEN bool_or(status LIKE 'FAIL%') THEN 'FAIL' WHEN bool_or(status = 'NOT_MEASURED') THEN 'NOT_MEASURED' ELSE 'PASS' END AS overall,
  coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (status LIKE 'FAIL%'), '') AS failed, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (status = 'NOT_MEASURED'), '') AS not_measured FROM d""")
def release_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VG-5: the worst of all gates, and which they are."""
    return M.overall(_decided(spark, sf_dir))


_NEED = {"R": 3, "A": 2, "N": 1}


@query("high_risk_support", """WITH s AS (SELECT l_returnflag AS predicate, l_partkey, l_suppkey, count(DISTINCT coalesce(o_custkey, -l_orderkey)) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT predicate, CASE predicate WHEN 'R' THEN 3 ELSE 2 END AS need, count(*) AS admitted, count(*) FILTER (n < CASE predicate WHEN 'R' THEN 3 ELSE 2 END) AS below FROM s WHERE predicate IN ('R', 'A') GROUP BY predicate""")
def high_risk_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VG-3: claims of predicates that need several independent sources, and those with fewer; sources are made distinct before they are counted."""
    need = spark.createDataFrame([(p, n) for p, n in _NEED.items() if n >= 2], "predicate string, need int")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("predicate"), "l_partkey", "l_suppkey", "l_orderkey").join(F.broadcast(need), "predicate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    units = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("predicate", "need", "l_partkey", "l_suppkey", F.coalesce("o_custkey", -F.col("l_orderkey")).alias("unit")).distinct()
    support = units.groupBy("predicate", "need", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return support.groupBy("predicate", "need").agg(F.count("*").alias("admitted"), F.count_if(F.col("n") < F.col("need")).alias("below"))


BANNED, NARRATIVE = ["Great Flood"], "传奇|故事|之路"
#: Nodes and relations that reach every rule.
_NODES = [
    ("unit", "u1", "North Lake", None, "a lake", "Lake"), ("unit", "u1", "North Lake again", None, "a lake", "Lake"), ("unit", "u2", "North Lake", None, "a lake", "Lake"), ("unit", "u3", "", "u2", "x", "Lake"), ("unit", "u4", "No Type", "u2", "x", None),
    ("unit", "u5", "Odd Type", "u2", "x", "Road"), ("unit", "u6", "Great Flood", "u2", "x", "Lake"), ("unit", "u7", "某某故事", "u2", "x", "Lake"), ("system", "s1", "North Lake", None, "x", "Basin"), ("unit", "u8", "Lost", "nowhere", "x", "Lake"),
    ("unit", "u9", "Ring A", "u10", "x", "Lake"), ("unit", "u10", "Ring B", "u11", "x", "Lake"), ("unit", "u11", "Ring C", "u9", "x", "Lake"), ("unit", "u12", "Leads in", "u9", "x", "Lake"), ("unit", "u13", "Own", "u13", "x", "Lake"), ("unit", "u14", "Alone", None, "x", "Lake"),
]
_RELATIONS = [("u1", "flows_into", "u2"), ("u1", "flows_into", "u2"), ("u2", "flows_into", "u3"), ("u3", "tributary_of", "u1"), ("u4", "likes", "u5"), ("u6", "part_of_basin", "u6"), ("u7", None, "u8"), ("u9", "adjacent_basin", "ghost"), ("u10", "upstream_of", "u11"), ("u12", "upstream_of", "u13")]
_CUSTOMERS = "SELECT 'customer' AS kind, 'c' || CAST(c_custkey AS STRING) AS id, c_name AS name, CASE WHEN c_custkey > 0 THEN 'c' || CAST(floor(c_custkey / 2) AS BIGINT) END AS parent, c_mktsegment AS description, CASE WHEN c_acctbal < -900 THEN 'Village' ELSE 'Valley' END AS type FROM customer "
_FLOWS = "SELECT 'c' || CAST(o_custkey AS STRING) AS a, 'adjacent_basin' AS relation, 'c' || CAST(o_orderkey % 1600 AS STRING) AS b FROM orders "


def _sql_rows(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _walk(parents: str) -> str:
    return f"SELECT DISTINCT s FROM (WITH RECURSIVE w AS (SELECT a AS s, b AS spot, 1 AS n FROM {parents} UNION ALL SELECT s, b, n + 1 FROM w JOIN {parents} ON a = spot WHERE spot <> s AND n < 60) SELECT s FROM w WHERE spot = s) z"


_TOLD = "coalesce(a, '?') || ' ' || coalesce(relation, '?') || ' ' || coalesce(b, '?')"
_BLANK = "trim(coalesce({x}, '')) = ''"


@query("vocabulary_lint", f"""WITH n AS MATERIALIZED (SELECT * FROM {_sql_rows(_NODES)} v(kind, id, name, parent, description, type) UNION ALL {_CUSTOMERS}), r AS MATERIALIZED (SELECT * FROM {_sql_rows(_RELATIONS)} v(a, relation, b) UNION ALL {_FLOWS}),
e AS MATERIALIZED (SELECT a AS id FROM r UNION SELECT b FROM r), p AS MATERIALIZED (SELECT id AS a, min(parent) AS b FROM n WHERE parent <> id AND parent IN (SELECT id FROM n) GROUP BY id), d AS MATERIALIZED (SELECT a, min(b) AS b FROM r WHERE relation IN ('tributary_of', 'flows_into') AND a <> b GROUP BY a)
SELECT DISTINCT * FROM (SELECT 'duplicate_id' AS code, 'nodes' AS place, id AS subject FROM n GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_name', kind, name FROM n GROUP BY kind, name HAVING count(DISTINCT id) > 1 UNION ALL SELECT 'duplicate_name', 'relations', {_TOLD} FROM r GROUP BY a, relation, b HAVING count(*) > 1
UNION ALL SELECT 'missing_metadata', kind, id FROM n WHERE {_BLANK.format(x='name')} OR {_BLANK.format(x='description')} OR {_BLANK.format(x='type')}
UNION ALL SELECT 'illegal_child_type', kind, id FROM n WHERE type NOT IN ({', '.join(map(repr, L.TYPES))}) OR name = 'Great Flood' UNION ALL SELECT 'illegal_child_type', 'relations', {_TOLD} FROM r WHERE relation NOT IN ({', '.join(map(repr, L.RELATIONS))})
UNION ALL SELECT 'narrative_leak', kind, id FROM n WHERE regexp_matches(name, '{NARRATIVE}') UNION ALL SELECT 'type_collision', 'nodes', name FROM n GROUP BY name HAVING count(DISTINCT kind) > 1
UNION ALL SELECT 'dangling_parent', kind, id FROM n WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.id = n.parent) UNION ALL SELECT 'dangling_parent', 'relations', id FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.id)
UNION ALL SELECT 'cycle', 'nodes', s FROM ({_walk('p')}) c UNION ALL SELECT 'self_parent', kind, id FROM n WHERE parent = id UNION ALL SELECT 'hydro_topology', 'self', {_TOLD} FROM r WHERE a = b
UNION ALL SELECT 'hydro_topology', 'cycle', s FROM ({_walk('d')}) c UNION ALL SELECT 'hydro_topology', 'untouched', id FROM n WHERE id NOT IN (SELECT id FROM e) AND kind IN (SELECT kind FROM n WHERE id IN (SELECT id FROM e))
UNION ALL SELECT 'untyped_relation', 'relations', {_TOLD} FROM r WHERE {_BLANK.format(x='relation')}) f""")
def vocabulary_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VG-7, RT-11, RT-13: eleven kinds of findings over customers as a tree, orders as relations, and nodes that reach every rule."""
    nodes = spark.createDataFrame(_NODES, "kind string, id string, name string, parent string, description string, type string").unionByName(made(spark, sf_dir, _CUSTOMERS))
    relations = spark.createDataFrame(_RELATIONS, "a string, relation string, b string").unionByName(made(spark, sf_dir, _FLOWS))
    return L.findings(nodes, relations, BANNED, NARRATIVE)


# an order's lines name parts as chunks; parts lead to suppliers as documents, these to nations as resources
_KNOWLEDGE = "SELECT o_orderkey AS node, CASE WHEN o_orderkey % 11 > 0 THEN {agg} END AS source FROM orders LEFT JOIN (SELECT *, l_partkey + CASE WHEN l_quantity > 45 THEN 100000000 ELSE 0 END AS part FROM lineitem ) l ON l_orderkey = o_orderkey GROUP BY o_orderkey"
_CHUNKS = "SELECT 'c' || CAST(p_partkey AS STRING) AS chunk, CASE WHEN p_size <> 5 THEN 'd' || CAST(p_partkey % 120 AS STRING) END AS doc FROM part WHERE p_size < 45 "
_DOCS = "SELECT 'd' || CAST(s_suppkey AS STRING) AS doc, 'n' || CAST(s_nationkey AS STRING) AS path FROM supplier WHERE s_acctbal > 0 "
_SOURCES = "SELECT 'n' || CAST(n_nationkey AS STRING) AS path FROM nation WHERE n_nationkey % 4 > 0 "


@query("chain_closure", f"""WITH k AS ({_KNOWLEDGE.format(agg="CASE WHEN o_orderkey % 2 = 0 THEN string_agg('c' || part, ' ; ' ORDER BY part) ELSE string_agg('c' || part, '<SEP>' ORDER BY part) END")}), r AS (SELECT node, trim(unnest(string_split_regex(source, ';|<SEP>'))) AS chunk FROM k),
l AS (SELECT node, c.chunk IS NOT NULL AS x, d.doc IS NOT NULL AS y, s.path IS NOT NULL AS z FROM (SELECT * FROM r WHERE chunk <> '') r LEFT JOIN ({_CHUNKS}) c USING (chunk) LEFT JOIN ({_DOCS}) d ON d.doc = c.doc LEFT JOIN ({_SOURCES}) s ON s.path = d.path)
SELECT k.node, count(x) AS refs, count(*) FILTER (NOT x) AS missing_chunk, count(*) FILTER (x AND NOT y) AS missing_doc, count(*) FILTER (y AND NOT z) AS missing_resource, coalesce(bool_or(z), false) AS closed,
  CASE WHEN bool_or(z) THEN NULL WHEN count(x) = 0 THEN 'no reference' WHEN bool_or(y) THEN 'no resource' WHEN bool_or(x) THEN 'no document' ELSE 'no chunk' END AS reason FROM k LEFT JOIN l ON l.node = k.node GROUP BY k.node""")
def chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-19: each node's references followed to chunks, documents and resources, and where they break."""
    agg = "array_join(transform(array_sort(collect_list(struct(part, l_linenumber, l_suppkey))), x -> concat('c', x.part)), CASE WHEN o_orderkey % 2 = 0 THEN ' ; ' ELSE '<SEP>' END)"
    return L.chains(made(spark, sf_dir, _KNOWLEDGE.format(agg=agg)), made(spark, sf_dir, _CHUNKS), made(spark, sf_dir, _DOCS), made(spark, sf_dir, _SOURCES))


# statements with a quote and a chunk: as written, with other punctuation, in another part, changed, and without a part
_QUOTED = """SELECT documents.doc_id, lang AS source, quality, CASE doc_id_5 WHEN 0 THEN q WHEN 1 THEN replace(q, ' ', '，') WHEN 2 THEN q WHEN 3 THEN reverse(q) ELSE q END AS quote,
  CASE WHEN doc_id_5 = 4 THEN 'doc' ELSE 'doc#' || CAST(CASE WHEN doc_id_5 = 2 THEN 1 ELSE 0 END AS STRING) END AS chunk_id, documents.text FROM documents JOIN (SELECT doc_id AS k, doc_id % 5 AS doc_id_5, substr(text, 21, 40) AS q FROM documents ) d ON k = documents.doc_id LEFT JOIN labels ON labels.doc_id = documents.doc_id """
_FORM = "regexp_replace(regexp_replace({x}, '[[:space:]　，。、；：？！“”‘’\"''（）()\\[\\]【】《》<>—\\-–_…·,.:;?!※◆●★☆→↑↓〓◎§]+', '', 'g'), '[⺀-⺟⻀-⻳〇○●◇◆□■△▲▽]', '', 'g')"
_RELOCATED = f"""q AS MATERIALIZED ({_QUOTED}), c AS (SELECT *, TRY_CAST(regexp_extract(chunk_id, '#([0-9]+)$', 1) AS INT) AS part FROM q),
x AS (SELECT *, coalesce(part * 1200 < length(text), false) AS chunk_exists, substr(text, part * 1200 + 1, 1200) AS chunk FROM c),
s AS MATERIALIZED (SELECT doc_id, chunk_exists, quality IS NOT NULL AS document_exists, source IS NOT NULL AS source_exists, CASE WHEN NOT chunk_exists OR quote IS NULL OR quote = '' THEN 'FAILED' WHEN contains(chunk, quote) THEN 'EXACT'
  WHEN length({_FORM.format(x="quote")}) >= 6 AND contains({_FORM.format(x="chunk")}, {_FORM.format(x="quote")}) THEN 'NORMALIZED' ELSE 'FAILED' END AS match FROM x)"""


def _relocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = made(spark, sf_dir, _QUOTED)
    part = F.regexp_extract("chunk_id", r"#(\d+)$", 1).try_cast("int")
    rows = q.withColumn("part", part).withColumn("chunk_exists", F.coalesce(F.col("part") * 1200 < F.length("text"), F.lit(False)))
    chunk = F.when(F.col("chunk_exists"), F.substr("text", F.col("part") * 1200 + 1, F.lit(1200)))
    return rows.select("doc_id", "chunk_exists", F.col("quality").isNotNull().alias("document_exists"), F.col("source").isNotNull().alias("source_exists"), text.bind(F.col("quote"), chunk).alias("match"))


@query("claim_relocation", f"WITH {_RELOCATED} SELECT doc_id, chunk_exists, match, CASE WHEN match = 'FAILED' THEN 'REVOKED' ELSE 'ADMITTED' END AS status FROM s")
def claim_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-8: every statement's quote bound anew to its chunk, as written or normalised; what binds no more is revoked."""
    return _relocated(spark, sf_dir).select("doc_id", "chunk_exists", "match", F.when(F.col("match") == "FAILED", "REVOKED").otherwise("ADMITTED").alias("status"))


@query("relocation_rates", f"WITH {_RELOCATED} SELECT count(*) AS checked, round(avg(CAST(chunk_exists AS INT)), 4) AS chunk_exists_rate, round(avg(CAST(document_exists AS INT)), 4) AS document_exists_rate, round(avg(CAST(source_exists AS INT)), 4) AS source_exists_rate, round(avg(CASE WHEN match = 'FAILED' THEN 0 ELSE 1 END), 4) AS relocated_rate FROM s")
def relocation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-28: rates of chunks, documents and sources that exist, and of quotes found again."""
    s = _relocated(spark, sf_dir)
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return s.agg(F.count("*").alias("checked"), rate(F.col("chunk_exists")).alias("chunk_exists_rate"), rate(F.col("document_exists")).alias("document_exists_rate"), rate(F.col("source_exists")).alias("source_exists_rate"), rate(F.col("match") != "FAILED").alias("relocated_rate"))
