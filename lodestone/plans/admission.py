"""Claims drafted from lines of orders, their ten-stage admission, its log and audit; answers of models as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tolerant
from ..operators import admission as A
from ..sources import table
from . import query

#: predicate, cardinality, domain, range, time and place required
PREDICATES = [
    ("located_in", "single", ["SMALL", "ECONOMY", "STANDARD"], ["0", "1", "2", "3"], False, True),
    ("built_by", "single", ["SMALL", "ECONOMY", "LARGE", "PROMO", "MEDIUM", "STANDARD"], ["0", "1", "2", "3", "4"], True, False),
    ("part_of", "multi", ["SMALL", "ECONOMY", "LARGE", "PROMO", "MEDIUM", "STANDARD"], ["0", "1", "2", "3", "4"], False, False),
    ("associated_with", "multi", ["LARGE", "PROMO", "MEDIUM", "ECONOMY"], ["1", "2", "3", "4"], False, False),
]
RULES = "claims-10"
_DRAFTS = """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
  CASE WHEN l_quantity <> 7 THEN l_partkey END AS subject, CASE WHEN l_quantity <> 9 THEN l_suppkey % 4 END AS object, CASE l_partkey % 9 WHEN 0 THEN 'unregistered' WHEN 1 THEN 'located_in' WHEN 2 THEN 'located_in' WHEN 3 THEN 'part_of' WHEN 4 THEN 'associated_with' ELSE 'built_by' END AS predicate,
  p_type AS subject_type, CAST(n_regionkey AS STRING) AS object_type, CASE WHEN p_size = 13 THEN 'UNRESOLVED' ELSE 'RESOLVED_EXISTING' END AS subject_state, CASE WHEN s_acctbal < 0 THEN 'UNRESOLVED' END AS object_state,
  p_name AS quote, CASE l_linenumber WHEN 1 THEN 'another text' WHEN 2 THEN 'the ' || replace(p_name, ' ', '，') || ' here' ELSE 'the ' || p_name || ' here' END AS chunk, CASE WHEN l_discount < 0.08 THEN CAST(year(l_shipdate) AS STRING) END AS time_text,
  CASE WHEN l_tax < 0.07 THEN n_name END AS place, CASE o_orderstatus WHEN 'F' THEN 'CORE' WHEN 'O' THEN 'CONTEXT' ELSE 'REJECTED' END AS scope, l_orderkey AS resource, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 50 END AS cluster,
  o_orderpriority AS source, CASE left(o_orderpriority, 1) WHEN '1' THEN 'S' WHEN '2' THEN 'A' WHEN '3' THEN 'B' WHEN '5' THEN 'C' END AS authority
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey"""


def decisions(spark: SparkSession, sf_dir: str, of=A.admit) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "orders")}
    sql = _DRAFTS
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return of(spark.sql(sql, **tables), spark.createDataFrame(PREDICATES, "predicate string, cardinality string, domain array<string>, range array<string>, time_required boolean, place_required boolean"))


def _list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


# the rules once more: failures by number, then what came before by plain windows
_PLAIN = f"""pr AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{c}', {_list(d)}, {_list(r)}, {t}, {l})" for p, c, d, r, t, l in PREDICATES)}) v(predicate, cardinality, dom, ran, needs_time, needs_place)),
d AS MATERIALIZED (SELECT d.*, cardinality, CASE WHEN contains(chunk, quote) THEN 'EXACT' WHEN length(replace(quote, ' ', '')) >= 6 AND contains(replace(replace(chunk, '，', ''), ' ', ''), replace(quote, ' ', '')) THEN 'NORMALIZED' ELSE 'FAILED' END AS bound,
  pr.predicate IS NULL AS f1, subject IS NULL OR object IS NULL AS f2a, subject_state = 'UNRESOLVED' OR coalesce(object_state = 'UNRESOLVED', false) AS f2b, NOT coalesce(list_contains(dom, subject_type) AND list_contains(ran, object_type), false) AS f3,
  coalesce(needs_time AND time_text IS NULL, false) AS f5, coalesce(needs_place AND place IS NULL, false) AS f6, coalesce(scope, '') NOT IN ('CORE', 'CONTEXT') AS f7 FROM ({_DRAFTS}) d LEFT JOIN pr USING (predicate)),
f AS MATERIALIZED (SELECT *, CASE WHEN f1 THEN 1 WHEN f2a OR f2b THEN 2 WHEN f3 THEN 3 WHEN bound = 'FAILED' THEN 4 WHEN f5 THEN 5 WHEN f6 THEN 6 WHEN f7 THEN 7 ELSE 0 END AS failed FROM d),
w AS MATERIALIZED (SELECT *, CASE WHEN cardinality = 'single' THEN first_value(object) OVER s END AS won, first_value(id) OVER s AS winner, coalesce(CAST(cluster AS VARCHAR), 'r' || resource) AS unit FROM f WHERE failed = 0 WINDOW s AS (PARTITION BY subject, predicate ORDER BY id)),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object, unit ORDER BY id) = 1 AS new_unit, row_number() OVER (PARTITION BY subject, predicate, object, resource ORDER BY id) = 1 AS new_resource,
  row_number() OVER (PARTITION BY subject, predicate, object, source ORDER BY id) = 1 AND source IS NOT NULL AS new_source FROM w WHERE won IS NULL OR won = object),
c AS (SELECT id, coalesce(sum(CAST(new_unit AS INT)) OVER b, 0) AS independent, coalesce(sum(CAST(new_resource AS INT)) OVER b, 0) AS resources, coalesce(sum(CAST(new_source AS INT)) OVER b, 0) AS sources, count(*) OVER b AS evidence
  FROM a WINDOW b AS (PARTITION BY subject, predicate, object ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS MATERIALIZED (SELECT f.id, f.failed, CASE WHEN f.failed = 2 AND f.f2a THEN 'REJECTED_PRE_INSERT' WHEN f.failed > 0 THEN 'REJECTED' WHEN w.won <> w.object THEN 'CONTESTED' ELSE 'ADMITTED' END AS status, {_list(A.STAGES)}[CASE WHEN f.failed > 0 THEN f.failed END] AS failed_stage,
  CASE WHEN f.failed = 0 THEN f.bound ELSE 'FAILED' END AS match, CASE WHEN f.failed > 0 THEN 0 ELSE 1 + coalesce(c.independent, 0) END AS independent, CASE WHEN f.failed > 0 THEN 0 ELSE 1 + coalesce(c.resources, 0) END AS resources,
  CASE WHEN f.failed > 0 THEN 0 ELSE 1 + coalesce(c.sources, 0) END AS sources, CASE WHEN f.failed > 0 THEN 0 ELSE 1 + coalesce(c.evidence, 0) END AS evidence, CASE WHEN w.won <> w.object THEN w.winner END AS conflict_with, f.authority, f.time_text, f.predicate
  FROM f LEFT JOIN w ON w.id = f.id LEFT JOIN c ON c.id = f.id)"""


@query("claim_gate", f"""WITH {_PLAIN} SELECT id, status, failed_stage, match, CAST(CASE WHEN failed > 0 THEN 0 WHEN status = 'CONTESTED' THEN 30 ELSE least(95, 35 + 15 * least(2, independent - 1) + CASE WHEN authority IN ('S', 'A') THEN 15 ELSE 0 END
  + CASE WHEN match = 'EXACT' THEN 10 ELSE 0 END + CASE WHEN time_text IS NULL THEN 0 ELSE 10 END + CASE WHEN predicate = 'associated_with' THEN 0 ELSE 10 END) END AS INT) AS confidence, CAST(independent AS BIGINT) AS independent, CAST(resources AS BIGINT) AS resources, CAST(sources AS BIGINT) AS sources, CAST(evidence AS BIGINT) AS evidence, conflict_with FROM z""")
def claim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-4, AG-6, AG-17: all ten stages, what earlier drafts support and contest, and the confidence."""
    return decisions(spark, sf_dir)


@query("claim_stage_log", f"""WITH {_PLAIN}, s AS (SELECT unnest({_list(A.STAGES)}) AS stage, unnest(range({len(A.STAGES)})) AS position)
SELECT id, CAST(position AS INT) AS position, stage, CASE WHEN position + 1 = failed THEN 'FAIL' ELSE 'PASS' END AS result FROM z JOIN s ON failed = 0 OR position < failed - CASE WHEN status = 'REJECTED_PRE_INSERT' THEN 1 ELSE 0 END""")
def claim_stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-4: the stages each draft went through."""
    return A.stage_log(decisions(spark, sf_dir, A.statuses))


@query("claim_audit", f"WITH {_PLAIN} SELECT 'adm-' || left(sha1('claim|' || id || '|' || status || '|{RULES}'), 16) AS key, 'claim' AS kind, id, status AS decision, '{RULES}' AS rule_version, coalesce(failed_stage, '') AS reason FROM z")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-15's audit row, of claims."""
    return A.audit(decisions(spark, sf_dir, A.statuses), RULES)


#: How a model writes the object o, by event.
_WRITTEN = """CASE event_id % 8 WHEN 0 THEN o WHEN 1 THEN concat('```json', chr(10), o, chr(10), '```') WHEN 2 THEN concat('The answer: ', o, ' (done)') WHEN 3 THEN left(o, instr(o, '"who"') + 2)
  WHEN 4 THEN replace(o, '"}}', '",},}') WHEN 5 THEN 'no json @@@ {{' WHEN 6 THEN left(o, instr(o, '"tags"') + 12) END"""


@query("tolerant_json", """SELECT event_id, event_id % 8 < 5 OR event_id % 8 = 6 AS ok, CASE WHEN event_id % 8 < 5 OR event_id % 8 = 6 THEN event_id END AS id, CASE WHEN event_id % 8 < 5 THEN event_type END AS tag, CASE WHEN event_id % 8 < 5 THEN user_id END AS k,
  CASE WHEN event_id % 8 IN (0, 1, 2, 4) THEN 'x}"y' END AS u FROM events""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-31: objects made of events, as models write them: plain, fenced, in prose, cut off, with last commas, broken."""
    o = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "tags": ["a, b", "'), F.col("event_type"), F.lit('"], "k": '), F.col("user_id").cast("string"), F.lit(', "who": {"u": "x}\\"y"}}'))
    written = table(spark, sf_dir, "events").withColumn("o", o).withColumn("v", tolerant.parsed(F.expr(_WRITTEN)))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return written.select("event_id", F.col("v").isNotNull().alias("ok"), get("$.id", "bigint").alias("id"), get("$.tags[1]", "string").alias("tag"), get("$.k", "bigint").alias("k"), get("$.who.u", "string").alias("u"))
