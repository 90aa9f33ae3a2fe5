"""Plans for gaps: three waves of queries, providers, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import planning as P
from ..sources import table
from . import query

#: Targets beside the names of parts: with other names, with characters that have a traditional form, empty.
TARGETS = [(-1, "汉口开埠"), (-2, "川盐济楚"), (-3, "湖广填四川与万里茶道"), (-4, "都江堰"), (-5, ""), (-6, "江汉关")]
_KINDS = list(P.GAP_FIELDS) + ["OTHER"]
_GAP = "CASE pmod(id, 7) " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name")).union(spark.createDataFrame(TARGETS, "id long, name string"))
    return rows.select("id", "name", F.expr(_GAP).alias("gap"))


def _list(x: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in x) + "] AS VARCHAR[])"


_TARGETS = f"""t AS (SELECT id, name, {_GAP.replace("pmod(id, 7)", "((id % 7) + 7) % 7")} AS gap FROM (SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in TARGETS)}) v(id, name)) x),
raw AS (SELECT id, gap, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT id, gap, list_concat([name], {", ".join(f"CASE WHEN contains(name, '{k}') THEN {_list(v)} ELSE {_list([])} END" for k, v in P.ALIASES.items())}, [translate(name, '{P.SIMPLIFIED}', '{P.TRADITIONAL}')]) AS l FROM t) y),
terms AS (SELECT id, gap, term, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM (SELECT id, gap, term, min(i) AS i FROM raw WHERE term <> '' GROUP BY ALL) z)"""


def _wave(n: int, purpose: str, most: int, parts: list[str]) -> str:
    rows = " UNION ALL ".join(parts)
    return f"SELECT id, {n} AS wave, '{purpose}' AS purpose, q, row_number() OVER (PARTITION BY id ORDER BY o) AS r, {most} AS most FROM (SELECT id, q, min(o) AS o FROM ({rows}) p{n} GROUP BY id, q) d{n}"


def _ends(base: int, most: int, ends: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT id, term || ' {e}' AS q, {base} + k * 100 + {j} AS o FROM terms WHERE k <= {most}" for j, e in enumerate(ends))


_LIMITS = "(VALUES " + ", ".join(f"('{g}', '{x}', {j})" for g in _KINDS for j, x in enumerate(P.limits_of(g)[:6])) + ") f(kind, x, j)"
_FIELDS = "(VALUES " + ", ".join(f"('{g}', '{x}', {j})" for g in _KINDS for j, x in enumerate(P.GAP_FIELDS.get(g, P.FLOW)[:3])) + ") f(kind, x, j)"


@query("research_waves", f"""WITH {_TARGETS}, w AS ({_wave(0, "overview", 8, [_ends(0, 4, ["历史"]), _ends(1000, 2, ["起源", "沿革", "考证"])])}
  UNION ALL {_wave(1, "field_fill", 10, [f"SELECT id, term || ' ' || x AS q, k * 100 + j AS o FROM terms JOIN {_LIMITS} ON kind = gap WHERE k <= 3", f"SELECT id, term || ' ' || x || ' 史料', 1000 + k * 100 + j FROM terms JOIN {_FIELDS} ON kind = gap WHERE k <= 2"])}
  UNION ALL {_wave(2, "contradiction", 6, [_ends(0, 3, ["争议"]), _ends(1000, 2, ["另一说"]), _ends(2000, 2, ["质疑 考证"])])})
SELECT id, wave, purpose, string_agg(q, '|' ORDER BY r) AS queries FROM w WHERE r <= most GROUP BY id, wave, purpose""")
def research_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GP-6, FN-36, WN-16: the queries of each wave for every target (of blank targets there are none)."""
    rows = _targets(spark, sf_dir).select("id", F.explode(P.waves(F.col("name"), F.col("gap"))).alias("w")).where(F.size("w.queries") > 0)
    return rows.select("id", "w.wave", "w.purpose", F.array_join("w.queries", "|").alias("queries"))


_CLASSES = ["LocalChronicle", "Unlisted", "Museum", "AcademicJournal"]


@query("provider_queries", f"""WITH {_TARGETS}, q AS (SELECT id, term, k FROM terms WHERE k <= 3), c AS (SELECT * FROM (VALUES ('LocalChronicle', '地方志', 1), ('Museum', '博物馆', 3), ('AcademicJournal', '学报 OR 期刊', 4)) v(c, x, n))
SELECT id, 'encyclopedia' AS provider, term AS query, 'Wikipedia' AS source_class FROM q UNION ALL SELECT id, 'web', term, 'GeneralWebsite' FROM q
UNION ALL SELECT id, 'web', term || ' ' || x, c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, k) AS r FROM q CROSS JOIN c) s WHERE r <= 6""")
def provider_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GP-7: the providers of a target's names, six limited queries in all."""
    plan = P.providers(F.slice(P.variants(F.col("name")), 1, 3), F.array(*map(F.lit, _CLASSES)))
    return _targets(spark, sf_dir).select("id", F.explode(plan).alias("p")).select("id", "p.provider", "p.query", "p.source_class")


_TOPICS = ["水利工程", "历史文化", "交通航运"]


@query("topic_grid", """WITH g AS (SELECT n_name || ' ' || t AS query, 1 AS layer FROM nation, (VALUES ('水利工程'), ('历史文化'), ('交通航运')) v(t) UNION ALL SELECT c_name || ' ' || t, 2 FROM (SELECT c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) c, (VALUES ('水利工程'), ('历史文化'), ('交通航运')) v(t) WHERE r <= 4
  UNION ALL SELECT DISTINCT p_type || ' ' || t, 3 FROM part, (VALUES ('水利工程'), ('历史文化'), ('交通航运')) v(t) UNION ALL SELECT r_name || ' 文化特征 概述', 4 FROM region)
SELECT query, min(layer) AS layer FROM g WHERE length(trim(query)) >= 4 GROUP BY query""")
def topic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GP-5: queries of places, of four cities of each, and of types, by topic; each once, by its first layer (in the surveyed code a second
    look at the set of known queries left empty texts in the lists)."""
    topics = F.explode(F.array(*map(F.lit, _TOPICS))).alias("t")
    spark_ = lambda df, c, n: df.select(F.col(c).alias("x"), topics).select(F.concat_ws(" ", "x", "t").alias("query"), F.lit(n).alias("layer"))
    cities = spark.sql("SELECT c_name FROM (SELECT c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM {c}) x WHERE r <= 4", c=table(spark, sf_dir, "customer"))
    rows = spark_(table(spark, sf_dir, "nation"), "n_name", 1).union(spark_(cities, "c_name", 2)).union(spark_(table(spark, sf_dir, "part").select("p_type").distinct(), "p_type", 3))
    rows = rows.union(table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(" 文化特征 概述")), F.lit(4)))
    return rows.where(F.length(F.trim("query")) >= 4).groupBy("query").agg(F.min("layer").alias("layer"))


@query("gap_tasks", f"""WITH {_TARGETS}, g AS (SELECT 'gap-' || left(sha1(gap || '|' || name), 12) AS gap_id, name, gap, row_number() OVER (PARTITION BY gap, name ORDER BY id) AS r FROM t WHERE name <> '')
SELECT gap_id, 'task-' || left(sha1(gap_id), 12) AS task_id, CASE WHEN name IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'RESOLVED' WHEN name IN (SELECT p_name FROM part WHERE p_size = 2) THEN 'KEEP' ELSE 'PLANNED' END AS status FROM g WHERE r = 1""")
def gap_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GP-8: one task a gap by a key of its own; names of parts of size 1 stand for gaps that closed, of size 2 for tasks that are there."""
    gaps = _targets(spark, sf_dir).where("name <> ''").select("gap", "name").distinct().select(F.concat(F.lit("gap-"), F.substring(F.sha1(F.concat_ws("|", "gap", "name")), 1, 12)).alias("gap_id"), "name")
    names = lambda n: table(spark, sf_dir, "part").where(f"p_size = {n}").select(F.col("p_name").alias("name")).distinct().withColumn(f"s{n}", F.lit(True))
    rows = gaps.join(names(1), "name", "left").join(names(2), "name", "left")
    return rows.select("gap_id", F.concat(F.lit("task-"), F.substring(F.sha1("gap_id"), 1, 12)).alias("task_id"), F.when(F.col("s1"), "RESOLVED").when(F.col("s2"), "KEEP").otherwise("PLANNED").alias("status"))
