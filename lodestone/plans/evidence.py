"""Evidence bundles: retrieval channels over names, events and graph edges, and structures checked against their quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import structures
from ..sources import table
from . import query
from .relational import statement

#: Seeds of the channels: a term of part names, one that only its trigrams find, one inside words, and one of another script.
SEEDS = [(1, "ring"), (2, "widgets"), (3, "smal rings"), (4, "NATION_1"), (5, "absent term"), (6, "in"), (7, "长江")]
#: Names beside those of parts.
NAMED = [(-1, "large ring 5"), (-2, "长江 ring"), (-3, "长江流域"), (-4, "")]
_SEEDS = "(VALUES " + ", ".join(f"({n}, '{t}')" for n, t in SEEDS) + ") s(seed, term)"
_NAMED = "(SELECT p_partkey AS quote, p_name AS name FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in NAMED) + ") v(quote, name))"
LEXICAL, CLAIMS, EVIDENCE, EVENTS, ONE_HOP, HOP_EVIDENCE, SIMILAR = 120, 200, 120, 40, 120, 80, 0.28


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words (of letters and digits of any script), each padded by two spaces before and one after."""
    word = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(word, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))))


_WORDS = r"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_TRIGRAMS = "list_distinct(flatten(list_transform(" + _WORDS + ", lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("lexical_channel", f"""WITH p AS (
  SELECT seed, quote, contains(lower(name), lower(term)) AS has, {_TRIGRAMS.format(x="term")} AS a, {_TRIGRAMS.format(x="name")} AS b FROM {_SEEDS} CROSS JOIN {_NAMED} n),
q AS (SELECT *, coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0) AS sim FROM p),
r AS (SELECT seed, quote, CASE WHEN has THEN 'term' ELSE 'trigram' END AS channel, sim FROM q WHERE has OR sim > {SIMILAR})
SELECT seed, quote, channel, round(sim, 9) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, channel ORDER BY CASE WHEN channel = 'term' THEN 0.0 ELSE -round(sim, 9) END, quote) AS n FROM r) x WHERE n <= {LEXICAL}""")
def lexical_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-1, FN-14: of each seed the names that hold its term, then those of similar trigrams; the best of
    each (a top-k report).  Seeds are few and sent to all tasks; each different name is compared once."""
    seeds = spark.createDataFrame(SEEDS, "seed int, term string").withColumn("a", trigrams(F.col("term")))
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("quote"), F.col("p_name").alias("name")).union(spark.createDataFrame(NAMED, "quote long, name string"))
    different = named.select("name").distinct().withColumn("b", trigrams(F.col("name")))
    common = F.size(F.array_intersect("a", "b"))
    similar = F.coalesce(F.round(common / F.nullif(F.size("a") + F.size("b") - common, F.lit(0)), 9), F.lit(0.0))
    met = different.join(F.broadcast(seeds), F.contains(F.lower("name"), F.lower("term")) | F.arrays_overlap("a", "b"))
    found = met.select("seed", "name", F.when(F.contains(F.lower("name"), F.lower("term")), "term").otherwise("trigram").alias("channel"), similar.alias("similarity")).where((F.col("channel") == "term") | (F.col("similarity") > SIMILAR))
    found = named.join(found, "name").select("seed", "quote", "channel", "similarity")
    return spark.sql(f"""SELECT seed, quote, channel, similarity FROM (SELECT *, row_number() OVER (PARTITION BY seed, channel ORDER BY CASE WHEN channel = 'term' THEN 0.0 ELSE -similarity END, quote) AS n FROM {{found}}) x WHERE n <= {LEXICAL}""", found=found)


_FOUND = """SELECT seed, order_no, line_no, row_number() OVER (PARTITION BY seed ORDER BY order_no, line_no) AS n FROM ({x}) f"""
_BY_ENDS = f"""SELECT s.seed, l_orderkey AS order_no, l_linenumber AS line_no FROM {_SEEDS} JOIN part ON contains(lower(p_name), lower(s.term)) JOIN lineitem ON l_partkey = p_partkey
  UNION SELECT s.seed, l_orderkey, l_linenumber FROM {_SEEDS} JOIN nation ON lower(n_name) = lower(s.term) JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey"""
_BY_OR = f"""SELECT DISTINCT s.seed, l_orderkey AS order_no, l_linenumber AS line_no FROM {_SEEDS} CROSS JOIN lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  WHERE contains(lower(p_name), lower(s.term)) OR lower(n_name) = lower(s.term)"""
_EVIDENCE = f"""SELECT seed, e.order_no, line_no, o_orderpriority AS authority FROM (
  SELECT f.*, row_number() OVER (PARTITION BY seed ORDER BY order_no, line_no) AS e FROM ({_FOUND}) f WHERE n <= {CLAIMS}) e JOIN orders ON o_orderkey = e.order_no WHERE e <= {EVIDENCE}"""
# RT-2: claims with an endpoint of that name, and their evidence
statement("entity_channel", _EVIDENCE.replace("{x}", _BY_ENDS), _EVIDENCE.replace("{x}", _BY_OR))

# RT-3: events by their name or description, with the sessions of their users where there are some
_EVENT_SEEDS = "(VALUES (1, 'click'), (2, '\"k\": 69'), (3, 'nothing')) s(seed, term)"
statement("event_channel", f"""SELECT seed, event_id, event_type, c_custkey FROM (
  SELECT s.seed, event_id, event_type, user_id, row_number() OVER (PARTITION BY s.seed ORDER BY event_id) AS n FROM {_EVENT_SEEDS} JOIN events ON contains(event_type, s.term) OR contains(props, s.term)) e
  LEFT JOIN customer ON c_custkey = user_id WHERE n <= {EVENTS}""")

# RT-4: the claims one step from the seed's entities, those found by name left out, and their evidence
_HOP_ENDS = f"""WITH own AS (SELECT s.seed, p_partkey AS part FROM {_SEEDS} JOIN part ON contains(lower(p_name), lower(s.term)))
SELECT seed, order_no, line_no, o_orderpriority AS authority FROM (
  SELECT f.*, row_number() OVER (PARTITION BY seed ORDER BY order_no, line_no) AS n FROM (
    SELECT DISTINCT near.seed, l_orderkey AS order_no, l_linenumber AS line_no FROM (SELECT DISTINCT own.seed, l_suppkey AS supplier FROM own JOIN lineitem ON l_partkey = part) near
      JOIN lineitem ON l_suppkey = supplier LEFT JOIN own mine ON mine.seed = near.seed AND mine.part = l_partkey WHERE mine.part IS NULL) f) g
  JOIN orders ON o_orderkey = order_no WHERE n <= {HOP_EVIDENCE}"""
statement("graph_channel", _HOP_ENDS)

# AD-14: objects with the fields and quotes that synthesis gave them
_ALL = {"FLOW": ["origin", "destination", "content"], "TRADITION": ["origin_time_place", "core_practices", "carriers", "development"], "PROCESS": ["time", "origin", "destination", "actors", "mechanism", "outcomes"]}
CASES: list[tuple[int, str, list[tuple[str, str | None, list[str]]], list[int]]] = [
    (1, "FLOW", [(f, "x", []) for f in _ALL["FLOW"]], [7]),
    (2, "FLOW", [(f, "x", ["Q0"]) for f in _ALL["FLOW"]], [7]),
    (3, "FLOW", [("origin", None, []), ("content", " ", ["Q0"])], [7]),
    (4, "FLOW", [(f, "x", ["Q99", "Q-1"]) for f in _ALL["FLOW"]], [7, 8]),
    (5, "PROCESS", [("time", "1900", []), ("origin", "x", ["Q0"])], [7]),
    (6, "TRADITION", [(f, "x", ["Q0"]) for f in _ALL["TRADITION"]], [7, 7]),
    (7, "PROCESS", [("time", "1900", ["Q0"])], [7, 8]),
    (8, "FLOW", [(f, "x", ["Q0", "Q1"]) for f in _ALL["FLOW"]], [7, 8]),
    (9, "PROCESS", [(f, "x", ["Q0", "Q1"]) for f in _ALL["PROCESS"][:5]] + [("stages", "a", ["Q0"]), ("stages", "b", ["Q1"])], [7, 8]),
    (10, "PROCESS", [(f, "x", ["Q0", "Q1"]) for f in _ALL["PROCESS"][:5]] + [("stages", "a", ["Q0"]), ("stages", "", ["Q1"])], [7, 8]),
    (11, "TRADITION", [(f, "x", ["Q0"]) for f in _ALL["TRADITION"][:3]] + [("regional_variants", "r", ["Q1"])], [7, 8]),
    (12, "TRADITION", [("core_practices", "x", ["Q0"]), ("modern_forms", "y", ["Q1"])], [7, 8]),
]
_ITEMS = [(o, k, i, f, v, q) for o, k, fs, _ in CASES for i, (f, v, q) in enumerate(fs)]
_BUNDLE = [(o, n, r) for o, _, _, rs in CASES for n, r in enumerate(rs)]


def _value(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "CAST([" + ", ".join(map(_value, x)) + "] AS VARCHAR[])" if isinstance(x, list) else f"'{x}'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + ")"


_KINDS_OF = {k: [*fs, *{"PROCESS": ["stages", "stages"], "TRADITION": ["regional_variants"]}.get(k, [])] for k, fs in _ALL.items()}
_MADE_ITEMS = f"""SELECT l_orderkey + 100 AS object, CASE l_orderkey % 3 WHEN 0 THEN 'FLOW' WHEN 1 THEN 'TRADITION' ELSE 'PROCESS' END AS kind, line AS item,
  CASE l_orderkey % 3 {" ".join(f"WHEN {i} THEN CASE line % {len(_KINDS_OF[k])} " + " ".join(f"WHEN {j} THEN '{f}'" for j, f in enumerate(_KINDS_OF[k])) + " END" for i, k in enumerate(("FLOW", "TRADITION", "PROCESS")))} END AS field,
  CASE WHEN l_quantity = 13 THEN NULL WHEN l_quantity = 14 THEN ' ' ELSE 'v' || CAST(l_partkey % 100 AS STRING) END AS value, 'Q' || CAST(l_partkey % 5 AS STRING) || ' Q' || CAST(l_suppkey % 7 AS STRING) AS quotes
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS line FROM lineitem ) l """
_MADE_BUNDLE = "SELECT o_orderkey + 100 AS object, CAST(n AS INT) AS n, CAST(o_custkey * 10 + CASE WHEN n < o_custkey % 5 THEN 0 ELSE n END AS BIGINT) AS resource FROM orders CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) q"


@query("structure_verify", f"""WITH i AS (SELECT * FROM {_values(_ITEMS)} v(object, kind, item, field, value, quotes) UNION ALL SELECT object, kind, item, field, value, string_split(quotes, ' ') FROM ({_MADE_ITEMS}) m),
b AS (SELECT object, 'Q' || n AS q, resource FROM {_values(_BUNDLE)} v(object, n, resource) UNION ALL SELECT object, 'Q' || n, resource FROM ({_MADE_BUNDLE}) m),
k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{f}', {f in structures.KEY[k]})" for k, fs in _ALL.items() for f in fs)}) v(kind, field, key)),
v AS (SELECT i.*, (SELECT count(*) FROM b WHERE b.object = i.object AND list_contains(i.quotes, b.q)) AS used FROM i),
lists AS (SELECT object, kind, field FROM v WHERE trim(coalesce(value, '')) <> '' AND used > 0 AND ((kind = 'PROCESS' AND field = 'stages') OR (kind = 'TRADITION' AND field = 'regional_variants'))
  GROUP BY object, kind, field HAVING count(*) >= CASE WHEN kind = 'PROCESS' THEN 2 ELSE 1 END),
support AS (SELECT DISTINCT v.object, v.field, key FROM v JOIN k ON k.kind = v.kind AND k.field = v.field WHERE trim(coalesce(value, '')) <> '' AND used > 0 UNION ALL SELECT object, field, false FROM lists),
cited AS (SELECT DISTINCT v.object, resource FROM v JOIN b ON b.object = v.object AND list_contains(v.quotes, b.q) LEFT JOIN lists l ON l.object = v.object AND l.field = v.field
  WHERE v.field NOT IN ('stages', 'regional_variants') OR (l.field IS NOT NULL AND trim(coalesce(v.value, '')) <> '')),
o AS (SELECT object, kind, (SELECT count(*) FROM k WHERE k.kind = i.kind) AS required, (SELECT count(*) FROM k WHERE k.kind = i.kind AND key) AS keys,
  (SELECT count(*) FROM support s WHERE s.object = i.object) AS supported, (SELECT count(*) FROM support s WHERE s.object = i.object AND key) AS held, (SELECT count(*) FROM cited c WHERE c.object = i.object) AS resources
  FROM (SELECT DISTINCT object, kind FROM i) i)
SELECT object, kind, supported, round(supported / required, 3) AS coverage, resources,
  CASE WHEN held < keys THEN CASE WHEN kind = 'FLOW' THEN 'REJECT' ELSE 'CANDIDATE' END WHEN resources >= 2 AND supported >= 0.85 * required THEN 'ADMITTED' WHEN resources >= 1 THEN 'SUPPORTED' ELSE 'CANDIDATE' END AS decision FROM o""")
def structure_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AD-14: decisions on the literal cases, and on an object of each order whose lines give its fields and quotes."""
    def made(sql: str) -> DataFrame:
        return spark.sql(sql.replace("FROM lineitem ", "FROM {lineitem} AS lineitem ").replace("FROM orders ", "FROM {orders} AS orders "), **{t: table(spark, sf_dir, t) for t in ("lineitem", "orders") if f"FROM {t} " in sql})

    lines = made(_MADE_ITEMS)
    objects = spark.createDataFrame([(o, k) for o, k, _, _ in CASES], "object long, kind string").union(lines.select("object", "kind").distinct())
    items = spark.createDataFrame([(o, i, f, v, q) for o, _, i, f, v, q in _ITEMS], "object long, item int, field string, value string, quotes array<string>")
    items = items.union(lines.select("object", "item", "field", "value", F.split("quotes", " ")))
    bundle = spark.createDataFrame(_BUNDLE, "object long, n int, resource long").union(made(_MADE_BUNDLE))
    return structures.verify(objects, items, bundle)
