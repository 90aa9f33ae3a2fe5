"""Bundles over claims made of lines, events, and documents: channels, passages, pool, choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators.retrieval import cosine
from ..operators.staging import staged
from ..sources import ROLE_SQL, table
from . import query

#: Seeds: terms, and fields that are looked for.
SEEDS = [(1, ["ring", "der "], ["time", "origin"]), (2, ["blue", "NATION_1", "le "], ["time"]), (3, ["click", "the "], []), (4, ["absent term"], ["outcomes"])]
LEXICAL, ENTITY, EVENTS, GRAPH = 40, 30, 10, 20


def _array(x: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in x) + "] AS VARCHAR[])"


_SEEDS = "(VALUES " + ", ".join(f"({s}, {_array(t)}, {_array(f)})" for s, t, f in SEEDS) + ") s(seed, terms, fields)"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEEDS, "seed int, terms array<string>, fields array<string>")


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label that admits them; the first line is the title, the language the query that found them."""
    admitted = table(spark, sf_dir, "labels").where(F.expr(ROLE_SQL) != "REJECT").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(admitted, "doc_id", "left_semi").select(F.col("doc_id").alias("resource"), F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"), F.col("lang").alias("query"), "text")


_PASSAGES = f"""r AS MATERIALIZED (SELECT doc_id AS resource, left(split_part(text, chr(10), 1), 60) AS title, lang AS query, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE {ROLE_SQL} <> 'REJECT') AND text <> ''),
h AS MATERIALIZED (SELECT seed, resource, terms FROM (SELECT seed, resource, terms, row_number() OVER (PARTITION BY seed ORDER BY length(title) DESC, resource) AS k FROM r JOIN {_SEEDS} ON len(list_filter(terms, lambda t: contains(lower(title), lower(t)) OR contains(lower(coalesce(query, '')), lower(t)))) > 0) x WHERE k <= 14),
pc AS (SELECT seed, resource, t, terms[t] AS term, string_split(text, terms[t]) AS p, text FROM h JOIN r USING (resource) CROSS JOIN range(1, 4) g(t) WHERE t <= len(terms)),
oc AS (SELECT seed, resource, t, term, text, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(term))) AS spot FROM pc),
fb AS (SELECT seed, resource, text, min(t * 100000000 + spot) AS v, arg_min(length(term), t * 100000000 + spot) AS size FROM oc GROUP BY seed, resource, text, CAST(floor(spot / 400) AS BIGINT)),
sn AS (SELECT seed, resource, v, trim(substr(text, CAST(greatest(v % 100000000 - 110, 0) AS BIGINT) + 1, CAST(least(v % 100000000 + size + 110, length(text)) - greatest(v % 100000000 - 110, 0) AS BIGINT)), chr(10) || ' ' || chr(9)) AS quote FROM fb),
ft AS MATERIALIZED (SELECT seed, resource, CAST(k AS INT) AS n, quote FROM (SELECT *, row_number() OVER (PARTITION BY seed, resource ORDER BY v) AS k FROM sn WHERE length({{key}}) >= 30) x WHERE k <= 2)"""
_KEY = r"""left(regexp_replace(quote, '[[:space:]，。、；：？！"''（）()\[\]【】《》<>—\-…·,.:;?!]+', '', 'g'), 120)"""
_PASSAGES = _PASSAGES.replace("{key}", _KEY)


@query("fulltext_passages", f"WITH {_PASSAGES} SELECT * FROM ft")
def fulltext_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-5: passages around the first hit in each bucket of admitted documents' whole texts."""
    return B.passages(_seeds(spark), _resources(spark, sf_dir))


_CLAIMS = """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS place, p_name || ' made by the house of ' || s_name || ' in ' || n_name || ', ' || CAST(year(l_shipdate) AS STRING) || '年' AS quote,
  l_orderkey AS resource, CASE left(o_orderpriority, 1) WHEN '1' THEN 'S' WHEN '2' THEN 'A' WHEN '5' THEN 'C' END AS authority, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 50 END AS cluster, p_name, n_name, l_suppkey AS supplier
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, channel, position, place, quote, resource, authority, cluster of the four channels over stored claims and of passages.
    Of each channel a seed takes a number of quotes, by place: the channels are searches with a limit."""
    sql = _CLAIMS
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "orders")}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    claims = spark.sql(sql, **tables).withColumns({"low_quote": F.lower("quote"), "low_part": F.lower("p_name"), "low_nation": F.lower("n_name")})
    seeds = F.broadcast(_seeds(spark).select("seed", "terms", F.transform("terms", F.lower).alias("low")))
    cols = ["quote", "resource", "authority", "cluster"]

    def found(rows: DataFrame, channel: str, position: int, most: int) -> DataFrame:
        return spark.sql(f"SELECT seed, '{channel}' AS channel, {position} AS position, place, {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place) AS _k FROM {{rows}}) x WHERE _k <= {most}", rows=rows)

    def held(*columns: str):
        return F.exists("low", lambda t: _either([F.contains(F.col(c), t) for c in columns]))

    # seeds by supplier whose claims they name; then every claim is looked at once for its three channels
    near = staged(claims.join(seeds, held("low_part", "low_nation")).groupBy("supplier").agg(F.collect_set("seed").alias("near")), "suppliers-of-seeds")
    ends, lexical = held("low_part", "low_nation"), held("low_quote")
    kind = lambda channel, position, most: F.struct(F.lit(channel).alias("channel"), F.lit(position).alias("position"), F.lit(most).alias("most"))
    kinds = F.array_compact(F.array(F.when(lexical, kind("lexical", 1, LEXICAL)), F.when(ends, kind("entity", 2, ENTITY)), F.when(~ends & F.array_contains("near", F.col("seed")), kind("graph", 4, GRAPH))))
    asked = claims.join(near, "supplier", "left").crossJoin(seeds).select("seed", F.inline(kinds), "place", *cols)
    first = Window.partitionBy("seed", "channel").orderBy("place")
    stored = asked.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= max(LEXICAL, ENTITY, GRAPH)).where("_k <= most").select("seed", "channel", "position", "place", *cols)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), F.concat("event_type", F.lit(" by user number "), F.col("user_id").cast("string"), F.lit(" with "), "props").alias("quote"), F.col("user_id").alias("resource"), F.lit("B").alias("authority"), F.lit(None).cast("long").alias("cluster"), "event_type")
    named = events.join(seeds, F.exists("terms", lambda t: F.contains(F.lower("event_type"), F.lower(t))))
    texts = B.passages(_seeds(spark), _resources(spark, sf_dir)).select("seed", F.lit("fulltext").alias("channel"), F.lit(5).alias("position"), (F.col("resource") * 10 + F.col("n")).alias("place"), "quote", "resource", F.lit(None).cast("string").alias("authority"), F.lit(None).cast("long").alias("cluster"))
    return stored.unionByName(found(named, "event", 3, EVENTS)).unionByName(texts)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with cosines of the resource's vector to the seed's."""
    pool = staged(B.pooled(_channels(spark, sf_dir)), "pool")
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    own = F.broadcast(_seeds(spark).select(F.col("seed").alias("_seed")).join(v.select(F.col("vec_id").alias("_seed"), F.col("v").alias("w")), "_seed"))
    near = pool.select("seed", "resource").distinct().join(v, F.col("resource") == F.col("vec_id")).join(own, F.col("seed") == F.col("_seed")).select("seed", "resource", F.round(cosine(F.col("v"), F.col("w")), 6).alias("semantic"))
    return B.score(pool.join(near, ["seed", "resource"], "left"), _seeds(spark))


_HAS = "len(list_filter(terms, lambda t: {x})) > 0"
_ANY = " OR ".join(f"contains(lower({c}), lower(t))" for c in ("p_name", "n_name"))
_LIMITED = "SELECT seed, '{c}' AS channel, {p} AS position, place, quote, resource, authority, cluster FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY place) AS k FROM ({x}) y) z WHERE k <= {m}"
_HITS = " + ".join(f"CAST(list_contains(fields, '{f}') AND ({' OR '.join(repr(w).join(['contains(quote, ', ')']) for w in ws)}) AS INT)" for f, ws in B.HINTS.items())
_POOL = f"""{_PASSAGES}, cl AS MATERIALIZED ({_CLAIMS}),
en AS MATERIALIZED (SELECT cl.*, seed, terms FROM cl JOIN {_SEEDS} ON {_HAS.format(x=_ANY)}),
ch AS MATERIALIZED ({_LIMITED.format(c="lexical", p=1, m=LEXICAL, x=f"SELECT cl.*, seed FROM cl JOIN {_SEEDS} ON {_HAS.format(x='contains(lower(quote), lower(t))')}")}
  UNION ALL {_LIMITED.format(c="entity", p=2, m=ENTITY, x="SELECT * FROM en")}
  UNION ALL {_LIMITED.format(c="event", p=3, m=EVENTS, x=f"SELECT seed, event_id AS place, event_type || ' by user number ' || user_id || ' with ' || props AS quote, user_id AS resource, 'B' AS authority, CAST(NULL AS BIGINT) AS cluster FROM events JOIN {_SEEDS} ON {_HAS.format(x='contains(lower(event_type), lower(t))')}")}
  UNION ALL {_LIMITED.format(c="graph", p=4, m=GRAPH, x=f"SELECT cl.*, s.seed FROM cl JOIN {_SEEDS} ON EXISTS (SELECT 1 FROM en WHERE en.seed = s.seed AND en.supplier = cl.supplier) WHERE NOT {_HAS.format(x=_ANY)}")}
  UNION ALL SELECT seed, 'fulltext', 5, resource * 10 + n, quote, resource, NULL, NULL FROM ft),
ke AS (SELECT *, {_KEY} AS key FROM ch), fi AS (SELECT *, row_number() OVER (PARTITION BY seed, key ORDER BY position, place) AS k FROM ke WHERE length(key) >= 12),
po AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY position, place, key) AS nth FROM fi WHERE k = 1),
pl AS MATERIALIZED (SELECT po.*, terms, fields, (SELECT array_to_string(list(channel ORDER BY position), ',') FROM (SELECT DISTINCT channel, position FROM fi WHERE fi.seed = po.seed AND fi.key = po.key) q) AS channels,
  (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) FROM embeddings a, embeddings b WHERE a.vec_id = po.resource AND b.vec_id = po.seed) AS sem FROM po JOIN {_SEEDS} USING (seed) WHERE nth <= 64)
SELECT seed, CAST(nth AS INT) AS place, quote, resource, channels, CAST(round(10000 * (0.3::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(sem, 0.5::DOUBLE))) + 0.2::DOUBLE * least(1.0::DOUBLE, 0.25::DOUBLE * ({_HITS}) + 0.15::DOUBLE * len(list_filter(terms, lambda t: contains(quote, t))))
  + 0.15::DOUBLE * CASE authority WHEN 'S' THEN 1.0::DOUBLE WHEN 'A' THEN 0.85::DOUBLE WHEN 'C' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END + 0.15::DOUBLE * CASE WHEN cluster IS NULL THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END
  + 0.1::DOUBLE * CASE WHEN length(key) > 220 THEN 0.6::DOUBLE WHEN length(key) >= 30 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + 0.05::DOUBLE * CASE WHEN regexp_matches(quote, '公元前?\\s*[0-9]+|[0-9]{{3,4}}') THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END
  + 0.05::DOUBLE * CASE WHEN regexp_matches(quote, '争议|另一说|一说|质疑|存疑|考证|或云|异说|分歧') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END)) AS INT) AS score FROM pl"""


@query("bundle_pool", f"WITH {_POOL}")
def bundle_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-6, ST-3: channels merged by what they say, with the hybrid score."""
    return _scored(spark, sf_dir).select("seed", "place", "quote", "resource", F.array_join("channels", ",").alias("channels"), "score")


@query("evidence_bundle")
def evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-7, RT-8: the diverse choice of each pool, numbered and cut; the choice is tested against a plain loop."""
    return B.bundle(_scored(spark, sf_dir))


#: Systems that a question names.
SYSTEMS = [(1, "ASIA"), (1, "EUROPE"), (2, "AFRICA"), (3, "nowhere")]
_SYSTEMS = "(VALUES " + ", ".join(f"({s}, '{n}')" for s, n in SYSTEMS) + ") y(seed, name)"
_CAPS = {"hydro": 12, "traditions": 8, "processes": 8, "flows": 6, "memberships": 12, "interpretations": 6}


def _section(name: str, rows: str, most: int) -> str:
    return f"SELECT seed, '{name}' AS section, CAST(r AS INT) AS r, item FROM (SELECT seed, item, row_number() OVER (PARTITION BY seed ORDER BY o, item) AS r FROM ({rows}) x) z WHERE r <= {most}"


_HELD = _HAS.format(x="contains(lower({c}), lower(t))")
_ASSEMBLY = " UNION ALL ".join([
    _section("systems", f"SELECT seed, name AS item, 0 AS o FROM {_SYSTEMS} WHERE name IN (SELECT r_name FROM region)", 99),
    _section("hydro", f"SELECT seed, p_name || ' ' || p_partkey AS item, p_partkey AS o FROM part JOIN {_SEEDS} ON {_HELD.format(c='p_name')}", 12),
    _section("phases", f"SELECT seed, CAST(y AS VARCHAR) AS item, y AS o FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) q, {_SEEDS}", 99),
    _section("traditions", f"SELECT seed, c_name AS item, c_custkey AS o FROM customer JOIN {_SEEDS} ON {_HELD.format(c='c_mktsegment')} OR {_HELD.format(c='c_name')}", 8),
    _section("processes", f"SELECT seed, s_name AS item, s_suppkey AS o FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN {_SEEDS} ON {_HELD.format(c='n_name')} OR {_HELD.format(c='s_name')}", 8),
    _section("flows", f"SELECT seed, event_type || ' ' || event_id AS item, event_id AS o FROM events JOIN {_SEEDS} ON {_HELD.format(c='event_type')}", 6),
    _section("memberships", f"SELECT seed, s_name AS item, -n AS o FROM (SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE NOT regexp_matches(s_name, '(0|7)$') GROUP BY s_name) m, {_SEEDS}", 12),
    _section("interpretations", f"SELECT seed, CAST(doc_id AS VARCHAR) AS item, doc_id AS o FROM (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE {ROLE_SQL} <> 'REJECT') i, {_SEEDS}", 6),
])


@query("question_assembly", f"SELECT * FROM ({_ASSEMBLY}) a")
def question_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-17: what a question is answered from, eight sections with their limits; the ninth, its evidence, is ``evidence_bundle``.

    Sections that don't look at terms are limited before they meet the seeds."""
    seeds = F.broadcast(_seeds(spark).select("seed", "terms"))
    t = lambda name: table(spark, sf_dir, name)

    def held(*columns: str):
        return F.exists("terms", lambda x: _either([F.contains(F.lower(c), F.lower(x)) for c in columns]))

    def top(name: str, rows: DataFrame, most: int) -> DataFrame:
        return spark.sql(f"SELECT seed, '{name}' AS section, CAST(r AS INT) AS r, item FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY o, item) AS r FROM {{rows}}) x WHERE r <= {most}", rows=rows)

    ids = lambda rows, item, o: rows.select("seed", F.col(item).cast("string").alias("item") if isinstance(item, str) else item.alias("item"), F.col(o).cast("long").alias("o"))
    named = spark.createDataFrame(SYSTEMS, "seed int, name string").join(t("region").select(F.col("r_name").alias("name")), "name", "left_semi").withColumn("o", F.lit(0))
    years = t("orders").select(F.year("o_orderdate").alias("y")).distinct()
    made = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    members = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where(~F.col("s_name").rlike("(0|7)$")).groupBy("s_name").agg((-F.sum("n")).alias("o")).orderBy("o", "s_name").limit(_CAPS["memberships"])
    first = t("documents").select("doc_id").join(t("labels"), "doc_id").where(F.expr(ROLE_SQL) != "REJECT").select("doc_id").orderBy("doc_id").limit(_CAPS["interpretations"])
    parts = [
        top("systems", ids(named, "name", "o"), 99), top("hydro", ids(t("part").join(seeds, held("p_name")), F.concat_ws(" ", "p_name", "p_partkey"), "p_partkey"), _CAPS["hydro"]), top("phases", ids(years.crossJoin(seeds), "y", "y"), 99),
        top("traditions", ids(t("customer").join(seeds, held("c_mktsegment", "c_name")), "c_name", "c_custkey"), _CAPS["traditions"]), top("processes", ids(made.join(seeds, held("n_name", "s_name")), "s_name", "s_suppkey"), _CAPS["processes"]),
        top("flows", ids(t("events").join(seeds, held("event_type")), F.concat_ws(" ", "event_type", "event_id"), "event_id"), _CAPS["flows"]), top("memberships", ids(members.crossJoin(seeds), "s_name", "o"), _CAPS["memberships"]),
        top("interpretations", ids(first.crossJoin(seeds), "doc_id", "doc_id"), _CAPS["interpretations"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _either(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
