"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` marks are quotes; the number of marks is their level.  Runs of
consecutive quoted lines of a level are passages.  Passages, and the lines they are made
of, are normalised (letters and digits, lower case) and hashed, and so are each message's
own text and own lines.  A quote's original is the latest earlier message of the
conversation with the same hash; a message's parent is the original that most of its
quotes of the lowest level with an original point to (a whole passage counts twice its
lines), the latest of equals.  Messages come in reply order: by conversation and thread,
parents first, a branch whole before the next one, branches by turn; quotes and the
"... wrote:" lines above them are dropped.

Originals are found by running maxima within blocks of ``BLOCK`` turns of a (conversation,
hash) and over the blocks' own maxima, so neither a long conversation nor a line said in
every turn gathers in one task, and no pairs are made.  Roots, depths, sizes of branches and
places follow by pointer doubling: each round is a join on unique (conv_id, turn).

Cases: null and empty texts have no quotes and an empty text; a null role is 'user'.
Messages without a conversation or turn are roots of their own.  Rows that repeat a
(conv_id, turn) keep a row each; as a reply's parent such a turn is one message, with the
latest of its parents, and its rows share that message's place.  Quotes without an original are dropped all the same.  Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import n_parts, staged, table

BLOCK = 256
_MARKS = r"^((?:[ \t]*>)+)[ \t]?"
_QUOTED = r"^[ \t]*>"
_WROTE = r"^.{0,200}\bwrote:[ \t]*$"


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\r?\n")


def own_text(text: Column) -> Column:
    """A message without quoted lines and the attribution lines above them."""
    cut = _lines(text)
    kept = F.filter(cut, lambda x, i: ~x.rlike(_QUOTED) & ~(x.rlike(_WROTE) & F.coalesce(F.get(cut, i + 1).rlike(_QUOTED), F.lit(False))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def _quotes(rows: DataFrame) -> DataFrame:
    """key, conv_id, turn, level, hash, weight of quoted passages and lines."""
    some = rows.where(F.coalesce(F.col("text").contains(">"), F.lit(False)) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    cut = some.select("key", "conv_id", "turn", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(_QUOTED)).distinct()
    marks = F.regexp_extract("line", _MARKS, 1)
    q = cut.select("key", "conv_id", "turn", "pos", F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"), _normal(F.regexp_replace("line", _MARKS, "")).alias("said"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("key", "level").orderBy("pos"))  # within one message
    q = q.withColumn("run", run).where("said <> ''")
    whole = q.groupBy("key", "conv_id", "turn", "level", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ").alias("said"), (2 * F.count("*")).alias("weight"))
    parts = q.select("key", "conv_id", "turn", "level", "said", F.lit(1).cast("long").alias("weight"))
    every = whole.select("key", "conv_id", "turn", "level", "said", "weight").union(parts)
    return every.select("key", "conv_id", "turn", "level", F.xxhash64("said").alias("hash"), "weight")


def _originals(rows: DataFrame) -> DataFrame:
    """conv_id, turn, hash of each message's own text and own lines."""
    own = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", own_text(F.col("text")).alias("own"))
    said = own.select("conv_id", "turn", F.explode(F.array_append(F.split("own", "\n"), F.col("own"))).alias("said")).select("conv_id", "turn", _normal(F.col("said")).alias("said"))
    return said.where("said <> ''").select("conv_id", "turn", F.xxhash64("said").alias("hash")).distinct()


def parents(rows: DataFrame) -> DataFrame:
    """key, parent_turn of messages with a quote whose original is known."""
    quotes = staged(_quotes(rows), "quotes")
    wanted = quotes.select("conv_id", "hash").distinct()
    said = _originals(rows).join(wanted, ["conv_id", "hash"], "left_semi")
    events = quotes.select("conv_id", "hash", "turn", "key", "level", "weight", F.lit(None).cast("long").alias("at")).union(
        said.select("conv_id", "hash", "turn", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long"), F.col("turn"))
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    events = staged(events, "events")
    tops = events.groupBy("conv_id", "hash", "block").agg(F.max("at").alias("top"))
    before = tops.withColumn("before", F.max("top").over(Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("conv_id", "hash", "block", "before")
    earlier = F.max("at").over(Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = events.withColumn("inside", earlier).where("key is not null").join(before, ["conv_id", "hash", "block"]).withColumn("parent_turn", F.coalesce("inside", "before")).where("parent_turn is not null")
    votes = found.groupBy("key", "level", "parent_turn").agg(F.sum("weight").alias("weight"))
    return votes.groupBy("key").agg(F.min_by("parent_turn", F.struct(F.col("level"), -F.col("weight"), -F.col("parent_turn"))).alias("parent_turn"))


def _roots(edges: DataFrame, step: Column | None = None) -> DataFrame:
    """conv_id, turn, root_turn, depth (the sum of the steps to the root, 1 each by default) from edges(conv_id, turn, parent_turn) with unique (conv_id, turn)."""
    jump = staged(edges.select("conv_id", "turn", F.col("parent_turn").alias("to"), (F.lit(1) if step is None else step).cast("long").alias("d")), "jump")
    while True:
        nxt = jump.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        more = jump.join(nxt, ["conv_id", "to"], "left")
        if not more.where("to2 is not null").limit(1).count():
            return jump.select("conv_id", "turn", F.col("to").alias("root_turn"), F.col("d").alias("depth"))
        jump = staged(more.select("conv_id", "turn", F.coalesce("to2", "to").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")), "jump")


def _sizes(edges: DataFrame) -> DataFrame:
    """conv_id, turn, n of each reply: messages of its branch, itself among them."""
    state = staged(edges.select("conv_id", "turn", F.col("parent_turn").alias("to"), F.lit(1).cast("long").alias("n")), "sizes")
    while True:
        # n counts those less than 2^k below; the ones 2^k below add what they count
        add = state.where("to is not null").groupBy("conv_id", F.col("to").alias("turn")).agg(F.sum("n").alias("more"))
        nxt = state.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("to2"))
        grown = state.join(add, ["conv_id", "turn"], "left").join(nxt, ["conv_id", "to"], "left")
        state = staged(grown.select("conv_id", "turn", F.col("to2").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "sizes")
        if not state.where("to is not null").limit(1).count():
            return state.select("conv_id", "turn", "n")


def _places(edges: DataFrame) -> DataFrame:
    """conv_id, turn, thread (its root), position of each reply: parents first, a branch whole before the next, branches by turn.

    A reply comes after its parent and the branches of the parent's earlier replies; these
    steps add up on the way to the root.
    """
    sized = staged(edges.join(_sizes(edges), ["conv_id", "turn"]).withColumn("block", F.floor(F.col("turn") / BLOCK)), "branches")
    tops = sized.groupBy("conv_id", "parent_turn", "block").agg(F.sum("n").alias("n"))
    before = tops.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id", "parent_turn").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inside = F.sum("n").over(Window.partitionBy("conv_id", "parent_turn", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    steps = sized.withColumn("inside", inside).join(before, ["conv_id", "parent_turn", "block"])
    at = _roots(steps, 1 + F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0)))
    return at.select("conv_id", "turn", F.col("root_turn").alias("thread"), F.col("depth").alias("position"))


def _named(messages: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows with parent_turn, _root, _depth, and the edges of the replies, if there are any."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("conv_id", "turn", "role", "text"))
    own = parents(rows)
    if not own.limit(1).count():
        return rows.select("*", *(F.lit(None).cast("long").alias(c) for c in ("parent_turn", "_root", "_depth"))), None
    own = staged(own, "parents")
    edges = staged(rows.join(own, "key").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn")), "edges")
    roots = _roots(edges)
    up = roots.select(F.col("conv_id"), F.col("turn").alias("parent_turn"), F.col("root_turn").alias("_root"), (F.col("depth") + 1).alias("_depth"))
    return rows.join(own, "key", "left").join(up, ["conv_id", "parent_turn"], "left"), edges


def _formatted(named: DataFrame, *more: str) -> DataFrame:
    quoted = F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(_QUOTED))).cast("long")
    # of a column made once: Catalyst would evaluate a second copy of the lambdas
    named = named.withColumn("_said", own_text(F.col("text")))
    said = F.col("_said")
    return named.select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), "parent_turn", F.coalesce("_root", "parent_turn", "turn").alias("root_turn"),
        F.coalesce("_depth", F.when(F.col("parent_turn").isNotNull(), 1).otherwise(0)).cast("long").alias("depth"), quoted.alias("n_quoted"), said.alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), said, F.lit("\n<|end|>\n")).alias("message"), *more,
    )


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, n_quoted, text, message of each row.

    ``message`` is the chat form: ``<|role|>``, the text without quotes, ``<|end|>``.
    """
    return _formatted(_named(messages)[0])


def conversations(messages: DataFrame) -> DataFrame:
    """The linked rows with ``thread`` and ``position``, in range partitions sorted by (conv_id, thread, position).

    Read in that order, the messages of a thread are its conversation.
    """
    named, edges = _named(messages)
    if edges is None:
        named = named.withColumns({"thread": F.col("turn"), "position": F.lit(0).cast("long")})
    else:
        named = named.join(staged(_places(edges), "places"), ["conv_id", "turn"], "left").withColumns({"thread": F.coalesce("thread", "turn"), "position": F.coalesce("position", F.lit(0))})
    order = ["conv_id", "thread", "position", "key"]
    # sorted before quotes are dropped and the chat form is made: only the raw text is sent
    return _formatted(named.repartitionByRange(n_parts(messages.sparkSession), *order).sortWithinPartitions(*order), "thread", "position")


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages in reply order; its SQL has no column for the place, ``op4_conversations`` has."""
    return conversations(table(spark, sf_dir, "conversations")).drop("thread", "position")


def op4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS t, row_number() OVER () AS k,
    string_split(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), chr(10)) AS cut FROM conversations),
x AS (SELECT k, conv_id, turn, unnest(cut) AS line, generate_subscripts(cut, 1) AS pos FROM c),
y AS (SELECT *, regexp_matches(line, '^[ \t]*>') AS q, lead(line) OVER (PARTITION BY k ORDER BY pos) AS nxt FROM x),
own AS (
  SELECT k, conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos)
    FILTER (NOT q AND NOT (regexp_matches(line, '^.{0,200}\bwrote:[ \t]*$') AND coalesce(regexp_matches(nxt, '^[ \t]*>'), false))), ''), '^\s+|\s+$', '', 'g') AS said
  FROM y GROUP BY k, conv_id, turn),
u AS (SELECT conv_id, turn, unnest(list_append(string_split(said, chr(10)), said)) AS said FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(said), '[^\p{L}\p{N}]+', ' ', 'g')) AS said FROM u),
z AS (
  SELECT k, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS said
  FROM y WHERE q AND conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, pos - row_number() OVER (PARTITION BY k, level ORDER BY pos) AS run FROM z),
p AS (
  SELECT k, conv_id, turn, level, string_agg(said, ' ' ORDER BY pos) AS said, 2 * count(*) AS weight FROM n WHERE said <> '' GROUP BY k, conv_id, turn, level, run
  UNION ALL SELECT k, conv_id, turn, level, said, 1 FROM n WHERE said <> ''),
f AS (SELECT p.k, p.level, p.weight, (SELECT max(o.turn) FROM o WHERE o.conv_id = p.conv_id AND o.said = p.said AND o.turn < p.turn) AS parent FROM p),
v AS (SELECT k, level, parent, sum(weight) AS weight FROM f WHERE parent IS NOT NULL GROUP BY k, level, parent),
b AS (SELECT k, parent FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, weight DESC, parent DESC) AS r FROM v) WHERE r = 1),
e AS (SELECT conv_id, turn, max(parent) AS parent FROM c JOIN b ON b.k = c.k GROUP BY conv_id, turn),
r AS (
  SELECT c.k, c.conv_id, b.parent AS node, 1 AS depth FROM c JOIN b ON b.k = c.k
  UNION ALL SELECT r.k, r.conv_id, e.parent, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.node),
top AS (SELECT k, min(node) AS root, max(depth) AS depth FROM r GROUP BY k)
SELECT c.conv_id, c.turn, c.role, b.parent AS parent_turn, coalesce(top.root, c.turn) AS root_turn, CAST(coalesce(top.depth, 0) AS BIGINT) AS depth,
  CAST(len(list_filter(cut, lambda l: regexp_matches(l, '^[ \t]*>'))) AS BIGINT) AS n_quoted, own.said AS text, '<|' || c.role || '|>' || chr(10) || own.said || chr(10) || '<|end|>' || chr(10) AS message
FROM c JOIN own ON own.k = c.k LEFT JOIN b ON b.k = c.k LEFT JOIN top ON top.k = c.k
"""
