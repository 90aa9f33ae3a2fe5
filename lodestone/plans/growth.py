"""Structural gaps and their upkeep, tasks and circuit, admission of events and members, resolution of names.

Each query's SQL is written apart from Spark's form.  Judges enter as the table of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates
from ..sources import table
from . import query
from .relational import statement

# GP-3: six detectors.  Entities are parts, processes are customers with orders as stages, traditions are
# suppliers with lines as evidence, structures are orders with clusters, systems are nations, routes are events.
_GAPS = """SELECT 'MISSING_SYSTEM_MEMBERSHIP' AS kind, concat('', CAST(p_partkey AS STRING)) AS ref, CAST(least(90, 40 + 5 * n) AS INT) AS priority
    FROM part JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey) c ON k = p_partkey WHERE p_size < 5
  UNION ALL SELECT 'MISSING_PROCESS_STAGE', CAST(c_custkey AS STRING), 70 FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s ON k = c_custkey WHERE c_acctbal > 0 AND coalesce(n, 0) < 2
  UNION ALL SELECT 'MISSING_EVIDENCE', CAST(s_suppkey AS STRING), 80 FROM supplier LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 AND l_quantity > 40 GROUP BY l_suppkey) e ON k = s_suppkey WHERE coalesce(n, 0) < 3
  UNION ALL SELECT 'SINGLE_SOURCE_STRUCTURE', concat('ORDER:', CAST(o_orderkey AS STRING)), 60 FROM orders JOIN (SELECT l_orderkey AS k FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1) s ON k = o_orderkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'MISSING_CROSS_REGION_LINK', concat(x.n_name, '<->', y.n_name), 65 FROM nation x JOIN nation y ON x.n_name < y.n_name LEFT JOIN (
      SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R') t
    ON a = least(x.n_nationkey, y.n_nationkey) AND b = greatest(x.n_nationkey, y.n_nationkey) WHERE a IS NULL
  UNION ALL SELECT 'MISSING_HYDRO_LINK', CAST(c_custkey AS STRING), 55 FROM customer LEFT ANTI JOIN events ON user_id = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0"""
_GAPS_PLAIN = """SELECT 'MISSING_SYSTEM_MEMBERSHIP' AS kind, CAST(p_partkey AS VARCHAR) AS ref, CAST(least(90, 40 + 5 * (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'N')) AS INT) AS priority
    FROM part WHERE p_size < 5 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'N')
  UNION ALL SELECT 'MISSING_PROCESS_STAGE', CAST(c_custkey AS VARCHAR), 70 FROM customer WHERE c_acctbal > 0 AND (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 2
  UNION ALL SELECT 'MISSING_EVIDENCE', CAST(s_suppkey AS VARCHAR), 80 FROM supplier WHERE (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount > 0.08 AND l_quantity > 40) < 3
  UNION ALL SELECT 'SINGLE_SOURCE_STRUCTURE', 'ORDER:' || o_orderkey, 60 FROM orders WHERE o_orderstatus = 'F' AND (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) = 1
  UNION ALL SELECT 'MISSING_CROSS_REGION_LINK', x.n_name || '<->' || y.n_name, 65 FROM nation x JOIN nation y ON x.n_name < y.n_name WHERE NOT EXISTS (
      SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
      WHERE l_returnflag = 'R' AND ((c_nationkey = x.n_nationkey AND s_nationkey = y.n_nationkey) OR (c_nationkey = y.n_nationkey AND s_nationkey = x.n_nationkey)))
  UNION ALL SELECT 'MISSING_HYDRO_LINK', CAST(c_custkey AS VARCHAR), 55 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)"""
statement("structural_gaps", _GAPS, _GAPS_PLAIN)
# GP-4: gaps found now against those that are open: new ones are written once, those found no more are closed.
# Open are the stage gaps of all customers, so that each of the three actions occurs.
_OPEN = "SELECT 'MISSING_PROCESS_STAGE' AS k, CAST(c_custkey AS {t}) AS r FROM customer"
statement("gap_sync", f"SELECT coalesce(kind, k) AS kind, CASE WHEN k IS NULL THEN 'WRITE' WHEN kind IS NULL THEN 'CLOSE' ELSE 'KEEP' END AS action, coalesce(ref, r) AS ref FROM ({_GAPS}) g FULL JOIN ({_OPEN.format(t='STRING')}) o ON k = kind AND r = ref",
  f"""WITH g AS ({_GAPS_PLAIN}), o AS ({_OPEN.format(t='VARCHAR')}) SELECT kind, 'WRITE' AS action, ref FROM g WHERE (kind, ref) NOT IN (SELECT k, r FROM o)
  UNION ALL SELECT kind, 'KEEP', ref FROM g WHERE (kind, ref) IN (SELECT k, r FROM o) UNION ALL SELECT k, 'CLOSE', r FROM o WHERE (k, r) NOT IN (SELECT kind, ref FROM g)""")
# GP-9: tasks by nation, and three that nobody worked on; what each gained decides its next status
_TASKS = "SELECT n_nationkey AS task FROM nation UNION ALL SELECT 1000 UNION ALL SELECT 1001"
statement("task_gain", f"""SELECT task, coalesce(claims, 0) AS claims, coalesce(resources, 0) AS resources, coalesce(independent, 0) AS independent, CASE WHEN claims > 0 THEN 'RESOLVED' ELSE 'NO_GAIN' END AS status FROM ({_TASKS}) t LEFT JOIN (
  SELECT nation AS k, sum(n) AS claims, count(*) AS resources, count(DISTINCT o_custkey) AS independent FROM (
    SELECT s_nationkey AS nation, l_orderkey AS o, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('A', 'R') GROUP BY s_nationkey, l_orderkey) x JOIN orders ON o_orderkey = o GROUP BY nation) g ON k = task""",
  f"""SELECT task, count(l_orderkey) AS claims, count(DISTINCT o_orderkey) AS resources, count(DISTINCT o_custkey) AS independent, CASE WHEN count(l_orderkey) > 0 THEN 'RESOLVED' ELSE 'NO_GAIN' END AS status FROM ({_TASKS}) t
  LEFT JOIN (SELECT * FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R')) x ON s_nationkey = task GROUP BY task""")
# GP-10: six counts of violations; any of them stops growth
statement("circuit_breaker", """SELECT *, CASE WHEN no_evidence + one_anchor + no_support + no_time + no_fields + broken > 0 THEN 'PAUSE_GROWTH' ELSE 'HEALTHY' END AS circuit FROM (
  SELECT sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS no_evidence, sum(CASE WHEN n = 1 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS one_anchor, sum(CASE WHEN returned = 0 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS no_support,
    sum(CASE WHEN o_orderdate IS NULL THEN 1 ELSE 0 END) AS no_time, sum(CASE WHEN coalesce(trim(o_orderpriority), '') = '' THEN 1 ELSE 0 END) AS no_fields FROM (
    SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, coalesce(n, 0) AS n, coalesce(returned, 0) AS returned FROM orders LEFT JOIN (
      SELECT l_orderkey AS k, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY l_orderkey) l ON k = o_orderkey) x) a
  CROSS JOIN (SELECT count(*) AS broken FROM lineitem LEFT ANTI JOIN orders ON o_orderkey = l_orderkey) b""",
  """SELECT *, CASE WHEN no_evidence + one_anchor + no_support + no_time + no_fields + broken > 0 THEN 'PAUSE_GROWTH' ELSE 'HEALTHY' END AS circuit FROM (SELECT
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS no_evidence, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)) AS one_anchor,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS no_support, (SELECT count(*) FROM orders WHERE o_orderdate IS NULL) AS no_time,
  (SELECT count(*) FROM orders WHERE o_orderpriority IS NULL OR trim(o_orderpriority) = '') AS no_fields, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS broken) x""")
# AD-6: events (orders) with a located quote (a line that was returned or accepted) are admitted; the first eight participants
# by line and six organisations by name take part
statement("event_admission", """SELECT o_orderkey AS event, CASE WHEN located THEN 'ADMITTED' ELSE 'CANDIDATE' END AS status, slice(transform(array_sort(who), x -> x.supplier), 1, 8) AS participants, slice(brands, 1, 6) AS organizations FROM orders JOIN customer ON c_custkey = o_custkey JOIN (
  SELECT l_orderkey AS k, max(l_returnflag <> 'N') AS located, collect_list(struct(l_linenumber AS line, l_suppkey AS supplier)) AS who, array_sort(collect_set(p_brand)) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) l ON k = o_orderkey""",
  """SELECT o_orderkey AS event, CASE WHEN count(*) FILTER (l_returnflag IN ('A', 'R')) > 0 THEN 'ADMITTED' ELSE 'CANDIDATE' END AS status, list(l_suppkey ORDER BY l_linenumber, l_suppkey)[1:8] AS participants, list_sort(list_distinct(list(p_brand)))[1:6] AS organizations
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
# AD-8 by exact quotes: a statement names its chunk as doc#part; it is revoked where its quote is in that part no longer
statement("claim_reverify", r"""SELECT doc_id, CASE WHEN length(quote) >= 6 AND contains(substr(body, CAST(regexp_extract(ref, '#(\\d+)$', 1) AS INT) * 1200 + 1, 1200), quote) THEN 'ADMITTED' ELSE 'REVOKED' END AS status FROM (
  SELECT doc_id, coalesce(text, '') AS body, substr(coalesce(text, ''), 1, 24) AS quote, concat(doc_id, '#', doc_id % 2) AS ref FROM documents) d""",
  """SELECT doc_id, CASE WHEN length(left(coalesce(text, ''), 24)) < 6 OR strpos(substr(coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 1201 END, 1200), left(coalesce(text, ''), 24)) = 0 THEN 'REVOKED' ELSE 'ADMITTED' END AS status FROM documents""")
# AD-9: contested pairs of a subject and predicate: the judge's action gives both sides' status; no answer keeps them contested
_PAIR = "SELECT l_partkey AS subject, l_returnflag AS predicate, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY l_partkey, l_returnflag HAVING min(l_suppkey) < max(l_suppkey)"
statement("contest_adjudication", f"""SELECT subject, predicate, a, b, coalesce(sa, 'CONTESTED') AS status_a, coalesce(sb, 'ADMITTED') AS status_b FROM ({_PAIR}) p LEFT JOIN labels ON doc_id = subject
  LEFT JOIN (VALUES (1, 0, 'ADMITTED', 'SUPERSEDED'), (0, 0, 'SUPERSEDED', 'ADMITTED'), (1, 1, 'CONDITIONAL', 'CONDITIONAL'), (0, 1, 'REJECTED', 'REJECTED')) m(q, t, sa, sb) ON q = quality AND t = toxic""",
  f"""SELECT subject, predicate, a, b, CASE WHEN quality IS NULL THEN 'CONTESTED' WHEN toxic = 0 AND quality = 1 THEN 'ADMITTED' WHEN toxic = 0 THEN 'SUPERSEDED' WHEN quality = 1 THEN 'CONDITIONAL' ELSE 'REJECTED' END AS status_a,
  CASE WHEN quality IS NULL THEN 'ADMITTED' WHEN toxic = 0 AND quality = 1 THEN 'SUPERSEDED' WHEN toxic = 0 THEN 'ADMITTED' WHEN quality = 1 THEN 'CONDITIONAL' ELSE 'REJECTED' END AS status_b FROM ({_PAIR}) p LEFT JOIN labels ON doc_id = subject""")
# AD-12: members with two orders or more are judged; without an answer they are demoted
statement("membership_judge", """SELECT o_custkey AS member, count(*) AS anchors, CASE WHEN max(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) = 1 THEN 'ADMITTED' ELSE 'CANDIDATE' END AS status FROM orders LEFT JOIN labels ON doc_id = o_custkey GROUP BY o_custkey HAVING count(*) >= 2""",
  """SELECT m.k AS member, m.n AS anchors, CASE WHEN m.k IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN 'ADMITTED' ELSE 'CANDIDATE' END AS status FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) m WHERE m.n >= 2""")
REGIONS = ["the ", "und ", "para ", "pour "]
_ROLES = "CASE lang WHEN 'en' THEN 'ACTOR' WHEN 'de' THEN 'WORK' ELSE 'CONTEXT' END"


@query("membership_nonplace", f"""SELECT doc_id, (SELECT min_by(r, i) FROM (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(REGIONS))}) v(i, r) WHERE strpos(text, r) > 0) AS region, {_ROLES} AS role FROM documents
  WHERE length(trim(text)) >= 20 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND ({" OR ".join(f"strpos(text, '{r}') > 0" for r in REGIONS)})""")
def membership_nonplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-13: descriptions of 20 characters and more that hold a region and have an admitted statement; the first region of the list."""
    admitted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 20)
    found = docs.select("doc_id", gates.first_held(F.col("text"), REGIONS).alias("region"), F.expr(_ROLES).alias("role")).where(F.col("region").isNotNull())
    return found.join(admitted, "doc_id", "left_semi")


# SM-4: a worker runs while its last sign is younger than an hour
statement("heartbeats", "SELECT user_id, max(ts) > any_value(now) - INTERVAL 1 HOUR AS running FROM events CROSS JOIN (SELECT max(ts) AS now FROM events) n GROUP BY user_id",
  "SELECT DISTINCT u.user_id, EXISTS (SELECT 1 FROM events e WHERE e.user_id IS NOT DISTINCT FROM u.user_id AND date_diff('microsecond', e.ts, (SELECT max(ts) FROM events)) < 3600000000) AS running FROM events u")
# DD-6 without aliases and vectors, DD-8: the funnel of a mention: its exact name and type; one that the judge takes for the same merges, more are ambiguous, none is new
_MENTIONS = "SELECT p_partkey AS mention, p_name AS name, p_type AS type FROM part WHERE p_partkey % 2 = 1"
_KNOWN = "SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS alias FROM part WHERE p_partkey % 2 = 0"
statement("resolve_funnel", f"""SELECT mention, CASE WHEN n = 1 THEN 'merge' WHEN n > 1 THEN 'ambiguous' ELSE 'new' END AS decision, CASE WHEN n = 1 THEN target END AS target FROM (
  SELECT m.mention, coalesce(sum(k.n), 0) AS n, min(k.target) AS target FROM ({_MENTIONS}) m LEFT JOIN (SELECT name, type, count(*) AS n, min(id) AS target FROM ({_KNOWN}) k LEFT SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) j ON doc_id = id GROUP BY name, type) k ON k.name = m.name AND k.type = m.type GROUP BY m.mention) x""",
  f"""WITH s AS (SELECT m.mention, k.id FROM ({_MENTIONS}) m JOIN ({_KNOWN}) k ON k.name = m.name AND k.type = m.type WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = k.id AND quality = 1))
  SELECT m.mention, 'new' AS decision, CAST(NULL AS BIGINT) AS target FROM ({_MENTIONS}) m WHERE m.mention NOT IN (SELECT mention FROM s) UNION ALL SELECT mention, CASE WHEN count(*) = 1 THEN 'merge' ELSE 'ambiguous' END, CASE WHEN count(*) = 1 THEN min(id) END FROM s GROUP BY mention""")
# DD-9: keys of candidates, and those that are not stored yet
statement("candidate_ids", "SELECT doc_id, sha1(concat_ws('|', 'doc', CAST(doc_id AS STRING), coalesce(lang, ''))) AS key FROM documents LEFT ANTI JOIN labels USING (doc_id)",
  "SELECT doc_id, sha1('doc|' || doc_id || '|' || coalesce(lang, '')) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
# DD-10 in part: answers of a known type with a quote, cut to their lengths; the others fail
statement("extraction_check", "SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'type' WHEN coalesce(trim(text), '') = '' THEN 'quote' ELSE 'ok' END AS verdict, substr(text, 1, 80) AS name, substr(text, 1, 300) AS description FROM conversations",
  "SELECT conv_id, turn, CASE WHEN role = 'user' OR role = 'assistant' THEN CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'quote' ELSE 'ok' END ELSE 'type' END AS verdict, left(text, 80) AS name, left(text, 300) AS description FROM conversations")
