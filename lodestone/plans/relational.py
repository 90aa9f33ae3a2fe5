"""Relational queries: joins, aggregates, windows and set operations in declarative SQL.

A query here is one statement that Spark plans itself; where the plain form would be a
nested loop (an OR over two endpoints, say) Spark's statement is rewritten to equi-joins
and the oracle keeps the plain one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import ENTITIES_SQL, ROLE_SQL, TABLES, table
from . import query


_WORDS = set("WHERE LEFT JOIN ON GROUP ORDER CROSS FULL EXCEPT UNION INTERSECT LIMIT HAVING INNER".split())


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a SQL statement over the tables; ``oracle`` differs where Spark's form was rewritten."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def named(m: re.Match) -> str:
        follows = re.match(r"\s+(?:AS\s+)?([A-Za-z_]+)", sql[m.end() :])
        own = follows and follows[1].upper() not in _WORDS
        return f"{m[1]} {{{m[2]}}}" + ("" if own else f" AS {m[2]}")

    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", named, sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    query(name, oracle or sql)(run)


# independent sources of a statement: distinct clusters, or the resource where it is in none.  A resource has one
# cluster, so lines are counted by resource, then resources by cluster, then clusters: no row is expanded.
_SUPPORT = """SELECT subject, predicate, object, sum(claims) AS claims, sum(resources) AS resources, count(*) AS independent, min(best) AS best, max(latest) AS latest FROM (
  SELECT subject, predicate, object, coalesce(o_custkey, -resource) AS unit, sum(n) AS claims, count(*) AS resources, min(o_orderpriority) AS best, max(last) AS latest FROM (
    SELECT l_partkey AS subject, l_returnflag AS predicate, l_suppkey AS object, l_orderkey AS resource, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey, l_returnflag, l_suppkey, l_orderkey) l
  LEFT JOIN orders ON o_orderkey = resource GROUP BY subject, predicate, object, coalesce(o_custkey, -resource)) u GROUP BY subject, predicate, object"""
_SUPPORT_PLAIN = """SELECT l_partkey AS subject, l_returnflag AS predicate, l_suppkey AS object, count(*) AS claims,
  count(DISTINCT l_orderkey) AS resources, count(DISTINCT coalesce(o_custkey, -l_orderkey)) AS independent, min(o_orderpriority) AS best, max(l_shipdate) AS latest
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey, l_returnflag, l_suppkey"""

_CONFIDENCE = "CAST(least(35 + 15 * least(greatest(independent - 1, 0), 2) + CASE WHEN best IN ('1-URGENT', '2-HIGH') THEN 15 ELSE 0 END + CASE WHEN claims > 1 THEN 10 ELSE 0 END + CASE WHEN latest IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN predicate <> 'N' THEN 10 ELSE 0 END, 95) AS INT)"

statement("independent_sources", _SUPPORT, _SUPPORT_PLAIN)  # AG-6
statement("claim_confidence", f"SELECT subject, predicate, object, claims, independent, {_CONFIDENCE} AS confidence FROM ({_SUPPORT}) s",
  f"SELECT subject, predicate, object, claims, independent, {_CONFIDENCE} AS confidence FROM ({_SUPPORT_PLAIN}) s")  # JN-1, AG-6, AG-17
# AG-18: bulk recomputation takes the greatest authority and match status of a claim's evidence by byte order, in which
# UNKNOWN > S > C > B > A and PENDING > NORMALIZED > FAILED > EXACT
_EVIDENCE_ROWS = """SELECT l_partkey AS subject, l_returnflag AS predicate, l_suppkey AS object, CASE left(o_orderpriority, 1) WHEN '1' THEN 'S' WHEN '2' THEN 'A' WHEN '3' THEN 'B' WHEN '5' THEN 'C' ELSE 'UNKNOWN' END AS authority,
  CASE WHEN l_quantity < 2 THEN 'PENDING' WHEN l_linestatus = 'O' THEN 'NORMALIZED' WHEN l_quantity > 49 THEN 'FAILED' ELSE 'EXACT' END AS match, coalesce(o_custkey, -l_orderkey) AS unit FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"""
_RECALC = "CAST(least(95, 35 + 15 * least(2, independent - 1) + CASE WHEN authority IN ('S', 'A') THEN 15 ELSE 0 END + CASE WHEN match = 'EXACT' THEN 10 ELSE 0 END + CASE WHEN predicate <> 'N' THEN 10 ELSE 0 END) AS INT)"
statement("confidence_recalc", f"""SELECT subject, predicate, object, authority, match, independent, {_RECALC} AS confidence FROM (SELECT subject, predicate, object, max(authority) AS authority, max(match) AS match, count(*) AS independent FROM (
  SELECT subject, predicate, object, unit, max(authority) AS authority, max(match) AS match FROM ({_EVIDENCE_ROWS}) e GROUP BY subject, predicate, object, unit) u GROUP BY subject, predicate, object) s""",
  f"""SELECT subject, predicate, object, authority, match, independent, {_RECALC} AS confidence FROM (SELECT subject, predicate, object, list_sort(list(authority), 'DESC')[1] AS authority,
  ['EXACT', 'FAILED', 'NORMALIZED', 'PENDING'][max(list_position(['EXACT', 'FAILED', 'NORMALIZED', 'PENDING'], match))] AS match, count(DISTINCT unit) AS independent FROM ({_EVIDENCE_ROWS}) e GROUP BY subject, predicate, object) s""")
statement("claim_star", """SELECT l_orderkey, l_linenumber, p_name AS subject, l_returnflag AS predicate, s_name AS object, n_name AS place
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag IN ('A', 'R')""")  # JN-1, JN-2, FL-3
# JN-5: endpoints are unpivoted, so the OR over subject and object becomes an equi-join
statement("endpoint_claims", """SELECT node, count(*) AS claims FROM (
    SELECT explode(array_distinct(array(c_nationkey, s_nationkey))) AS node FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) b GROUP BY node""",
  """SELECT n_nationkey AS node, count(*) AS claims FROM nation JOIN (SELECT c_nationkey AS cn, s_nationkey AS sn FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) a ON n_nationkey = cn OR n_nationkey = sn GROUP BY n_nationkey""")
_NATIONS = "(SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ISLE_A', 0), (101, 'ISLE_B', 0), (102, 'ISLE_C', 1)) v(n_nationkey, n_name, n_regionkey))"
# JN-6, JN-7: pairs of nations of a region without trade in either direction; the dimension side is fixed in size
_TRADE = "SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey"
statement("symmetric_pair_gap", f"""SELECT x.n_name AS a, y.n_name AS b FROM {_NATIONS} x JOIN {_NATIONS} y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name
  LEFT ANTI JOIN ({_TRADE}) t ON least(x.n_nationkey, y.n_nationkey) = t.a AND greatest(x.n_nationkey, y.n_nationkey) = t.b""",
  f"""SELECT x.n_name AS a, y.n_name AS b FROM {_NATIONS} x JOIN {_NATIONS} y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name
  WHERE NOT EXISTS (SELECT 1 FROM ({_TRADE}) t WHERE (t.a = x.n_nationkey AND t.b = y.n_nationkey) OR (t.a = y.n_nationkey AND t.b = x.n_nationkey))""")
statement("symmetric_pair_gap_all", f"""SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name
  LEFT ANTI JOIN ({_TRADE}) t ON least(x.n_nationkey, y.n_nationkey) = t.a AND greatest(x.n_nationkey, y.n_nationkey) = t.b""",
  f"""SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name
  WHERE NOT EXISTS (SELECT 1 FROM ({_TRADE}) t WHERE (t.a = x.n_nationkey AND t.b = y.n_nationkey) OR (t.a = y.n_nationkey AND t.b = x.n_nationkey))""")
statement("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")  # JN-3
_CUSTOMERS = "(SELECT c_custkey, c_name FROM customer UNION ALL SELECT * FROM (VALUES (-1, 'nobody'), (CAST(NULL AS INT), 'unknown')) v(c_custkey, c_name))"
statement("missing_evidence_anti", f"SELECT c_custkey, c_name FROM {_CUSTOMERS} c LEFT ANTI JOIN orders ON o_custkey = c_custkey", f"SELECT c_custkey, c_name FROM {_CUSTOMERS} c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")  # JN-4
statement("correlated_counts", "SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")  # JN-9
statement("phase_mentions", "SELECT r_name, count(n_name) AS mentions FROM region LEFT JOIN nation ON contains(lower(n_name), lower(substr(r_name, 1, 2))) GROUP BY r_name")  # JN-10
statement("first_evidence", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_orderkey AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")  # JN-11, WN-3
# JN-12: failures of the last 14 days before an anchor, beside the user's total
statement("recent_failures", """SELECT u.user_id, u.n AS events, coalesce(f.n, 0) AS failures FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '14' DAY GROUP BY user_id) f ON f.user_id = u.user_id""")
statement("tree_paths", "SELECT r_name || '/' || n_name AS path, 2 AS depth, n_nationkey AS leaf FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 1, NULL FROM region")  # JN-13, RT-12
statement("orphan_check", """SELECT 'no_customer' AS code, CAST(o_orderkey AS BIGINT) AS ref FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL
  UNION ALL SELECT 'self_loop', CAST(l_orderkey AS BIGINT) FROM lineitem WHERE l_partkey = l_suppkey
  UNION ALL SELECT 'duplicate_triple', CAST(min(l_orderkey) AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey HAVING count(*) > 1
  UNION ALL SELECT 'untouched', CAST(p_partkey AS BIGINT) FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) l ON l_partkey = p_partkey WHERE l_partkey IS NULL""")  # RT-13
statement("stats_view", f"""SELECT * FROM (SELECT count(*) AS resources, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents) a
  CROSS JOIN (SELECT count(*) FILTER (WHERE role = 'CORE') AS core, count(*) FILTER (WHERE role = 'CONTEXT') AS context, count(*) FILTER (WHERE role = 'REJECT') AS rejected
    FROM (SELECT {ROLE_SQL} AS role FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id) v) b
  CROSS JOIN (SELECT count(*) AS claims FROM lineitem) c CROSS JOIN (SELECT count(*) AS events, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-29 23:00:00') AS last_hour FROM events) d""")  # AG-1..4: one-row sides
statement("predicate_pivot", """SELECT coalesce(o_orderpriority, 'UNKNOWN') AS priority, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_, count(*) FILTER (WHERE l_returnflag = 'R') AS r
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY coalesce(o_orderpriority, 'UNKNOWN')""")  # AG-5
statement("scope_pass_rate", f"""SELECT source, count(*) AS n, sum(ok) AS ok, sum(ok) * 100 / greatest(1, count(*)) AS percent FROM (SELECT source, CASE WHEN {ROLE_SQL} = 'REJECT' THEN 0 ELSE 1 END AS ok
  FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id) v GROUP BY source""".replace("sum(ok) * 100 / greatest(1, count(*))", "CAST(floor(sum(ok) * 100 / greatest(1, count(*))) AS BIGINT)").replace("sum(ok) AS ok", "CAST(sum(ok) AS BIGINT) AS ok"))  # AG-9, AD-1, AD-2
statement("daily_counts_14d", "SELECT date_format(ts, 'MM-dd') AS day, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '14' DAY GROUP BY date_format(ts, 'MM-dd')",
  "SELECT strftime(ts, '%m-%d') AS day, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '14' DAY GROUP BY 1")  # AG-11, FL-6
statement("role_histogram", f"SELECT {ROLE_SQL} AS role, lang, count(*) AS n FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY 1, 2")  # AG-10, AG-12, AG-16
statement("event_participants", "SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS participants FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")  # AG-13
statement("duplicate_names", "SELECT p_name, count(*) AS refs, min(p_partkey) AS canonical FROM part GROUP BY p_name HAVING count(*) > 1")  # AG-14, WN-12
statement("brand_types", "SELECT p_brand, array_join(sort_array(collect_set(p_type)), ',') AS types FROM part GROUP BY p_brand", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")  # AG-15
statement("gain_by_day", """SELECT day, n, before, CASE WHEN n > before THEN 1 ELSE 0 END AS gain FROM (SELECT day, n, lag(n) OVER (ORDER BY day) AS before
  FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, count(*) AS n FROM events GROUP BY 1) d) e""")  # AG-20, WN-10: a row a day is sorted
statement("latest_status", "SELECT o_custkey, max_by(o_orderstatus, struct(o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")  # WN-2
statement("distinct_on_priority", """SELECT p_brand, p_type, p_size, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) x
  WHERE r = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")  # WN-1
statement("round_robin_pick", "SELECT p_brand, p_partkey, r FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) x WHERE r <= 3")  # WN-8, WN-13
statement("penalised_order", """SELECT user_id, n, failures, CASE WHEN failures >= 2 THEN n * 4 ELSE n * 10 END AS priority FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures
  FROM events GROUP BY user_id) x ORDER BY CASE WHEN failures >= 2 THEN n * 4 ELSE n * 10 END DESC, user_id LIMIT 50""")  # WN-11
statement("entity_search", f"SELECT entity_id, name, type FROM {ENTITIES_SQL} e WHERE lower(name) LIKE '%an%' ORDER BY name NULLS LAST, entity_id LIMIT 20 OFFSET 20")  # FL-1, FL-2, WN-14
statement("null_safe_change", "SELECT labels.doc_id, quality, toxic FROM labels WHERE quality IS DISTINCT FROM (1 - toxic)")  # FL-5
statement("name_exclusion", "SELECT p_partkey, p_name FROM part WHERE NOT (lower(p_name) LIKE '%a%' OR lower(p_name) LIKE '%e%1') AND p_size > 10")  # FL-4
statement("json_path_events", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY get_json_object(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")  # FL-7
statement("unregistered", "SELECT DISTINCT p_brand FROM part LEFT ANTI JOIN (SELECT 'Brand#1' AS b UNION ALL SELECT 'Brand#12') r ON b = p_brand", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#12')")  # FL-9
statement("drift_verify", """SELECT coalesce(a.k, e.k) AS k, CASE WHEN a.k IS NULL THEN 'MISSING' WHEN e.k IS NULL THEN 'UNEXPECTED' WHEN a.v <> e.v THEN 'MISMATCH' ELSE 'SAME' END AS drift
  FROM (SELECT c_nationkey AS k, count(*) AS v FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS v FROM supplier GROUP BY s_nationkey) e ON a.k = e.k""")  # JN-18, VG-6
# each pair is looked at once: of one of the two kinds only
statement("triple_difference", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey, l_suppkey HAVING bit_or(CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END) < 3",
  """(SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
  UNION (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")  # ST-1, ST-4
statement("type_collision", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")  # ST-2
# ST-3: channels of a user; the first by priority is kept, all are listed
statement("channel_union", "SELECT user_id, min_by(channel, p) AS first_channel, array_join(sort_array(collect_set(channel)), ',') AS channels FROM (SELECT user_id, 'buy' AS channel, 1 AS p FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'view', 2 FROM events WHERE event_type = 'view') u GROUP BY user_id",
  "SELECT user_id, arg_min(channel, p) AS first_channel, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM (SELECT user_id, 'buy' AS channel, 1 AS p FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'view', 2 FROM events WHERE event_type = 'view') u GROUP BY user_id")
statement("upsert_latest", "SELECT k, v, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM (SELECT c_custkey AS k, c_mktsegment AS v, 'old' AS src, 0 AS seq FROM customer UNION ALL SELECT o_custkey, o_orderpriority, 'new', o_orderkey FROM orders WHERE o_orderstatus = 'P') u) x WHERE r = 1")  # SNK-1
statement("insert_absent", "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY o_custkey")  # SNK-2, SNK-7
statement("delete_cascade", "SELECT l_partkey, l_suppkey, count(*) AS edges FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY l_partkey, l_suppkey")  # SNK-3
statement("fill_from_join", "SELECT d.doc_id, coalesce(nullif(CAST(l.quality AS VARCHAR(9)), ''), d.lang) AS filled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")  # SNK-4, SNK-5
# AG-7, AG-8: the fine cells first, then merged cells sum the distinct counts, as the reference shape does
_CUBE = """SELECT region, year, priority, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(independent) AS BIGINT) AS independent FROM (
  SELECT r_name AS region, extract(YEAR FROM l_shipdate) AS year, p_brand, o_orderpriority AS priority, count(*) AS claims, count(DISTINCT o_custkey) AS independent
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY r_name, extract(YEAR FROM l_shipdate), p_brand, o_orderpriority) fine GROUP BY region, year, priority"""
statement("coverage_cube", f"SELECT *, least(CAST(1.0 AS DOUBLE), CAST(claims AS DOUBLE) / 20 + CAST(independent AS DOUBLE) / 16) AS score FROM ({_CUBE}) c")
# JN-15, GP-1: the full grid of the axes (fixed vocabularies) against the cube
def _grid(cube: str) -> str:
    return f"""SELECT g.region, g.year, g.priority, coalesce(claims, 0) AS claims, coalesce(independent, 0) AS independent FROM
  (SELECT r_name AS region, y AS year, p AS priority FROM region CROSS JOIN (SELECT DISTINCT extract(YEAR FROM l_shipdate) AS y FROM lineitem) ys CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) ps) g
  LEFT JOIN ({cube}) c ON c.region = g.region AND c.year = g.year AND c.priority = g.priority"""


_GRADE = "CASE WHEN claims = 0 THEN 'EMPTY' WHEN independent = 0 THEN 'VERY_LOW' WHEN independent <= 1 AND claims < 3 THEN 'SINGLE_SOURCE' WHEN 4 * claims + 5 * independent < 20 THEN 'LOW_EVIDENCE' END"
statement("coverage_cube_all", f"SELECT *, least(CAST(1.0 AS DOUBLE), CAST(claims AS DOUBLE) / 20 + CAST(independent AS DOUBLE) / 16) AS score FROM ({_CUBE}) c")
for _name, _of in (("gap_grid", _CUBE), ("gap_grid_all", _CUBE)):
    statement(_name, f"SELECT region, year, priority, gap, least(10, 4 + CASE WHEN gap = 'EMPTY' THEN 2 ELSE 1 END + CASE WHEN independent = 0 THEN 2 ELSE 1 END) AS tenths FROM (SELECT *, {_GRADE} AS gap FROM ({_grid(_of)}) x) y WHERE gap IS NOT NULL")
# JN-15, GP-1 over four keys, in which cells without claims occur: the grid is made of the axes, the cube joined to it; the oracle counts for each cell
_CELL = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN customer ON c_custkey = o_custkey"
_AXES = "(SELECT n_nationkey AS nation, y AS year, p AS priority, b AS brand FROM nation CROSS JOIN (SELECT DISTINCT extract(YEAR FROM l_shipdate) AS y FROM lineitem) ys CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) ps CROSS JOIN (SELECT DISTINCT p_brand AS b FROM part) bs)"
_TENTHS = "least(10, 4 + CASE WHEN gap = 'EMPTY' THEN 2 ELSE 1 END + CASE WHEN independent = 0 THEN 2 ELSE 1 END)"
statement("gap_cells", f"""SELECT nation, year, priority, brand, claims, gap, {_TENTHS} AS tenths FROM (SELECT *, {_GRADE} AS gap FROM (SELECT g.*, coalesce(claims, 0) AS claims, coalesce(independent, 0) AS independent FROM {_AXES} g LEFT JOIN (
  SELECT n, y, p, b, sum(c) AS claims, count(*) AS independent FROM (SELECT c_nationkey AS n, extract(YEAR FROM l_shipdate) AS y, o_orderpriority AS p, p_brand AS b, o_custkey, count(*) AS c {_CELL} GROUP BY ALL) u GROUP BY n, y, p, b) k
  ON n = nation AND y = year AND p = priority AND b = brand) x) z WHERE gap IS NOT NULL""",
  f"""SELECT nation, year, priority, brand, claims, gap, CASE WHEN gap = 'EMPTY' THEN 8 WHEN independent = 0 THEN 7 ELSE 6 END AS tenths FROM (SELECT *, CASE WHEN claims = 0 THEN 'EMPTY' WHEN independent = 0 THEN 'VERY_LOW' WHEN claims < 3 AND independent < 2 THEN 'SINGLE_SOURCE'
  WHEN least(1, 0.5 * claims / 10 + 0.5 * independent / 8) < 0.25 THEN 'LOW_EVIDENCE' END AS gap FROM (SELECT nation, year, priority, brand, count(l_orderkey) AS claims, count(DISTINCT o_custkey) AS independent FROM {_AXES} g
  LEFT JOIN (SELECT * {_CELL}) l ON c_nationkey = nation AND extract(YEAR FROM l_shipdate) = year AND o_orderpriority = priority AND p_brand = brand GROUP BY nation, year, priority, brand) x) z WHERE gap IS NOT NULL""")
# GP-2: gaps may leave a key open; a union over the patterns of open keys keeps equi-joins
for _name, _of in (("gap_autoresolve", _CUBE), ("gap_autoresolve_all", _CUBE)):
    statement(_name, f"""SELECT DISTINCT region, year FROM (SELECT g.region, g.year FROM (SELECT r_name AS region, 1995 AS year FROM region) g JOIN ({_of}) c ON c.region = g.region AND c.year = g.year WHERE claims >= 2
  UNION ALL SELECT g.region, CAST(NULL AS INT) FROM (SELECT r_name AS region FROM region) g JOIN ({_of}) c ON c.region = g.region WHERE claims >= 2) u""")
# AD-4: first failed stage of ten; conflicts compare with the first accepted object of the subject
_ADMISSION = """SELECT l_orderkey, l_linenumber, CASE WHEN predicate IS NULL THEN 'schema' WHEN p_partkey IS NULL OR s_suppkey IS NULL THEN 'endpoints' WHEN p_size > 45 THEN 'domain_range' WHEN l_quantity < 2 THEN 'quote'
    WHEN l_shipdate IS NULL THEN 'temporal' WHEN n_name IS NULL THEN 'spatial' WHEN o_orderstatus = 'P' THEN 'scope' END AS failed,
    CASE WHEN predicate IS NULL OR p_partkey IS NULL OR s_suppkey IS NULL OR p_size > 45 OR l_quantity < 2 OR l_shipdate IS NULL OR n_name IS NULL OR o_orderstatus = 'P' THEN 'REJECTED'
      WHEN l_suppkey <> first_object THEN 'CONTESTED' ELSE 'ADMITTED' END AS status
  FROM (SELECT l.*, l.l_returnflag AS predicate, p_partkey, p_size, s_suppkey, n_name, o_orderstatus,
      first_value(CASE WHEN p_size <= 45 AND l_quantity >= 2 AND n_name IS NOT NULL AND o_orderstatus <> 'P' THEN l_suppkey END) IGNORE NULLS OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_object
    FROM lineitem l LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey) a"""
statement("claim_admission", _ADMISSION, _ADMISSION.replace("END) IGNORE NULLS OVER", "END IGNORE NULLS) OVER"))
statement("conflict_pairs", "SELECT l_partkey, l_returnflag, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY l_partkey, l_returnflag HAVING count(DISTINCT l_suppkey) = 2")  # AD-10
# AD-11: anchors of an entity by kind, admitted from two kinds on
statement("membership_anchors", """SELECT s_suppkey, spatial + temporal + domain AS anchors, CASE WHEN spatial + temporal + domain >= 2 AND spatial = 1 THEN 'ADMITTED' ELSE 'CANDIDATE' END AS status, least(9, 3 + 2 * (spatial + temporal + domain)) AS strength
  FROM (SELECT s_suppkey, max(CASE WHEN c_nationkey = s_nationkey THEN 1 ELSE 0 END) AS spatial, max(CASE WHEN extract(YEAR FROM l_shipdate) = 1995 THEN 1 ELSE 0 END) AS temporal, max(CASE WHEN p_size < 3 THEN 1 ELSE 0 END) AS domain
    FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey) a""")
statement("merge_cascade", "SELECT l_orderkey, l_linenumber, coalesce(canonical, l_partkey) AS part FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical FROM part) m ON p_partkey = l_partkey")  # DD-5
statement("gate_decisions", """SELECT gate, sample, violations, CASE WHEN sample < minimum THEN 'NOT_MEASURED' WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'customers_exist' AS gate, count(*) AS sample, count(*) FILTER (WHERE c_custkey IS NULL) AS violations, 30 AS minimum FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'negative_balance', count(*), count(*) FILTER (WHERE s_acctbal < 0), 30 FROM supplier UNION ALL SELECT 'regions', count(*), 0, 30 FROM region) g""")  # VG-1..5
statement("confusion_metrics", """SELECT count(*) FILTER (WHERE p = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE p = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE p = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE p = 0 AND toxic = 0) AS tn
  FROM (SELECT toxic, CASE WHEN lower(text) LIKE '%idiot%' OR lower(text) LIKE '%moron%' THEN 1 ELSE 0 END AS p FROM labels JOIN documents ON documents.doc_id = labels.doc_id) x""")  # AG-21..26
statement("majority_vote", "SELECT user_id, max_by(event_type, struct(n, -first_ts)) AS vote FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_ts FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type) v GROUP BY user_id",
  "SELECT user_id, event_type AS vote FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_ts) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_ts FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type) v) WHERE r = 1")  # AG-21
statement("run_delta", "SELECT a.event_type, a.n AS before, b.n AS after, b.n - a.n AS delta FROM (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type) a JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) b ON b.event_type = a.event_type")  # AG-30
statement("graph_edges", "SELECT 'in_region' AS kind, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION ALL SELECT DISTINCT 'supplies', CAST(l_suppkey AS BIGINT), CAST(l_partkey AS BIGINT) FROM lineitem")  # RT-14
statement("provider_plan", "SELECT brand, provider, r FROM (SELECT brand, provider, row_number() OVER (PARTITION BY brand ORDER BY rank) AS r FROM (SELECT DISTINCT p_brand AS brand FROM part) t CROSS JOIN (SELECT 'encyclopedia' AS provider, 1 AS rank UNION ALL SELECT 'archive', 2 UNION ALL SELECT 'journal', 3) s) x WHERE r <= 2")  # GP-5..7
