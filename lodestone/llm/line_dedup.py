"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct words (lower-cased, cut at ASCII white space).  A later line
whose tokens have a Jaccard similarity of 75 % or more with any earlier line, in order of
(doc_id, line number; of rows with the same doc_id see below), is removed.

1.  Equal lines are one class of two 64-bit hashes, represented by its first line, whose words
    are cut and hashed once.
2.  Rarity.  One pass counts these tokens in 2**18 hashed cells (a table of fixed size); a line's
    tokens are ordered by their cell's count, in quarters of a power of 2, then by hash.
3.  Leaders.  Classes that agree in the three least or greatest token hashes with more than
    ``SMALL`` others are compared with the first class of these, and all that are left with the
    leaders that many have followed.  Most of a large group of near copies is removed here by a
    few comparisons a line.  A removed class is no longer asked for.
4.  Prefix, positional and length filters.  Of two lines of n <= m tokens that match, the
    first n - ceil(6 n / 7) + 1 tokens of one and m - ceil(3 m / 4) + 1 of the other share a
    token.  At positions p, q at most min(p, q) + min(n - p, m - q) tokens are common.  Lists of
    frequent tokens are split by powers of 2 of the length, and those of very frequent ones
    again, so that removed classes never meet each other.  Signatures in which each token
    flips a bit bound the symmetric difference from below and spare most comparisons; those of
    lines of more than ``WIDE`` words have more bits.
5.  Pairs are verified on the lines' words themselves, a line's nearest candidate first.

Cases: null and empty texts have one line without words; lines without words stay.  Rows
that repeat a doc_id and its text are one document.  Rows of a doc_id with different texts,
and rows without a doc_id, are documents of their own, told apart and ordered by a hash of
the text; rows without a doc_id come first in the order.  Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import release, staged, table

CELLS = 1 << 18
SMALL = 16
#: Lists of tokens that are counted so often are split by length, and by whether classes are removed.
OFTEN = 64
VERY_OFTEN = 4096
#: Lines of more words have 256 further bits of signature; in 128 bits long lines that differ look alike.
WIDE = 128
#: So many leaders follow each other in a group.
ROUNDS = 2
#: Postings of one partition of the join.
PART = 1 << 20
#: Up to this many candidate lines (32 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def words(line: Column) -> Column:
    """Lower-case words.  Most lines have no white space but single characters that need no pattern."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\n"))
    return F.array_remove(F.split(F.lower(F.when(odd, F.regexp_replace(line, _SPACE, " ")).otherwise(line)), " "), "")


def row(text: Column) -> Column:
    """Tells rows apart that have no doc_id or the same one."""
    return F.xxhash64(text.cast("string"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no (from 0), line, and the class (id, id2) of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row(F.col("text")).alias("row"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return cut.select("*", F.xxhash64("line").alias("id"), F.xxhash64(F.lit("second"), "line").alias("id2"))


def _rank(count: int) -> int:
    """The count's logarithm in quarters of a power of 2, up to what a byte holds."""
    n = max(count, 1)
    return min(127, 4 * n.bit_length() + (n * 4 >> n.bit_length()))


def _cells(classes: DataFrame) -> Column:
    """The ranks of all cells, as one folded array."""
    found = classes.select(F.explode("tokens").alias("t")).groupBy(_cell(F.col("t")).alias("cell")).agg(F.count("*").alias("n")).toArrow()
    ranks = [_rank(0)] * CELLS
    for c, n in zip(found.column("cell").to_pylist(), found.column("n").to_pylist(), strict=True):
        ranks[c] = _rank(n)
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<tinyint>")


def _cell(token: Column) -> Column:
    return token.bitwiseAND(F.lit(CELLS - 1))


def _tokens(docs: DataFrame) -> DataFrame:
    """id, id2, first (doc_id, row, line_no), tokens (a 32-bit hash of each distinct word) of each class of equal lines with words."""
    said = lines(docs).where(F.col("line").rlike(_WORD))
    one = said.groupBy("id", "id2").agg(F.min(F.struct(F.struct("doc_id", "row", "line_no").alias("first"), "line")).alias("x"))
    return one.select("id", "id2", "x.first", F.transform(F.array_distinct(words(F.col("x.line"))), lambda w: F.hash(w)).alias("tokens"))


def _classes(tokens: DataFrame) -> DataFrame:
    """id, id2, first, n, bits, wide, least, greatest, prefix of each class.

    Two words of a line may share a hash: n counts words, and tokens of equal hashes stand side by side."""
    cells = _cells(tokens)
    n = F.size("tokens")
    key = F.sort_array(F.transform("tokens", lambda t: F.shiftleft(F.get(cells, _cell(t)).cast("long"), 32).bitwiseOR(t.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))))

    def signature(of, at=lambda t: t) -> Column:
        """Bits that each token of one part flips one of."""
        flip = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), at(t).bitwiseAND(F.lit(63)))
        return F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: F.when(of(t), a.bitwiseXOR(flip(t))).otherwise(a))

    bits = F.struct(signature(lambda t: t < 0).alias("a"), signature(lambda t: t >= 0).alias("b"))
    quarter = lambda k: signature(lambda t: F.shiftright(t, 24).bitwiseAND(F.lit(3)) == k, lambda t: F.shiftright(t, 18))
    wide = F.when(n > WIDE, F.struct(*(quarter(k).alias("abcd"[k]) for k in range(4))))
    # three tokens that many unrelated lines don't share; all of them in lines of fewer than six
    some = F.sort_array("tokens")
    least = F.xxhash64(F.when(n < 6, some).otherwise(F.slice(some, 1, 3)))
    greatest = F.xxhash64(F.lit("greatest"), F.when(n < 6, some).otherwise(F.slice(some, -3, 3)))
    return tokens.select("id", "id2", "first", n.alias("n"), bits.alias("bits"), wide.alias("wide"), least.alias("least"), greatest.alias("greatest"), F.slice(key, 1, F.floor(n / 4).cast("int") + 1).alias("prefix"))


def _flipped(bits: Column, other: Column) -> Column:
    return F.bit_count(bits["a"].bitwiseXOR(other["a"])) + F.bit_count(bits["b"].bitwiseXOR(other["b"]))


def _near(bits: Column, other: Column, n: Column, m: Column) -> Column:
    """Whether the signatures allow a match: each token of the symmetric difference, which has
    (n + m) / 7 tokens at most, makes at most one bit differ."""
    return 7 * _flipped(bits, other) <= n + m


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, id2 of the later class of each pair (a, b of ids) that matches, by the words of its lines."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    want = staged(classes.select("id", "id2", "first").join(ids, "id", "left_semi").select(F.col("first.doc_id").alias("_d"), F.col("first.row").alias("_r"), F.col("first.line_no").alias("_l"), "id", "id2", "first"), "wanted")
    on_doc = want.groupBy("_d", "_r").agg(F.collect_list(F.struct("_l", "id", "id2", "first")).alias("wanted"))
    on_doc = F.broadcast(on_doc) if want.count() <= BROADCAST_ROWS else on_doc.hint("shuffle_hash")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row(F.col("text")).alias("row"))
    rows = d.join(on_doc, d.doc_id.eqNullSafe(on_doc["_d"]) & (d.row == on_doc["_r"])).select(F.split(F.coalesce("text", F.lit("")), "\n").alias("cut"), F.explode("wanted").alias("w"))
    sets = rows.select("w.id", "w.id2", "w.first", F.array_distinct(words(F.get(F.col("cut"), F.col("w._l")))).alias("words"))
    sets = staged(sets.dropDuplicates(["id", "id2"]), "sets")

    def side(x: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), F.struct("id", "id2").alias(f"{x}_id"), F.col("first").alias(f"{x}_first"), F.col("words").alias(f"{x}_words"))

    common = F.size(F.array_intersect("a_words", "b_words"))
    hit = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * common >= 75 * (F.size("a_words") + F.size("b_words") - common))
    later = staged(hit.select(F.when(F.col("a_first") > F.col("b_first"), F.col("a_id")).otherwise(F.col("b_id")).alias("x")).select("x.*").distinct(), "later")
    release(want, sets)
    return later


def _led(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, id2 of the classes that match one of the first of a large group of agreeing ones.

    What doesn't match the leader but isn't far from it has the first of these as its next leader, as
    long as there are many.  Then all that is left is compared with the leaders that many have followed."""
    keyed = classes.select(F.explode(F.array("least", "greatest")).alias("key"), "first", "id", "n", "bits")
    one = F.struct("first", "id", "n", "bits")
    n, m, far = F.col("n"), F.col("x.n"), _flipped(F.col("bits"), F.col("x.bits"))
    near = (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * far <= n + m)

    def members(rows: DataFrame, by: str) -> DataFrame:
        led = rows.groupBy(by).agg(F.count("*").alias("c"), F.min(one).alias("x")).where(F.col("c") > SMALL).select(by, "x")
        met = rows.drop("x").join(led, by).where((F.col("id") != F.col("x.id")) & (14 * far <= 3 * (n + m)))
        return staged(met.select("x", F.col("x.id").alias("a"), "first", "id", "n", "bits", near.alias("near")).distinct(), "led")

    rows, found, leaders = members(keyed, "key"), [], []
    for more in range(ROUNDS - 1, -1, -1):
        found.append(_verified(docs, classes, rows.where("near").select("a", F.col("id").alias("b"))))
        followed = rows.join(found[-1].select("id"), "id", "left_semi").groupBy("a").agg(F.count("*").alias("c"), F.first("x").alias("x"))
        leaders.append(staged(followed.where(F.col("c") > SMALL).select("a", "x"), "leaders"))
        left = rows.join(found[-1].select("id"), "id", "left_anti")
        if not more or not left.groupBy("a").count().where(F.col("count") > SMALL).limit(1).count():
            break
        last, rows = rows, members(left, "a")
        release(last)
    release(rows)
    every, first = _all(found), _all(leaders).dropDuplicates(["a"])
    if (many := first.count()):
        asked = first.join(classes.select(F.col("id").alias("a"), F.explode("prefix").alias("token")), "a")
        asked = F.broadcast(asked) if many <= BROADCAST_ROWS // 64 else asked
        open_ = classes.join(_few(every.select("id")), "id", "left_anti").select("id", "n", "bits", F.explode("prefix").alias("token"))
        pairs = staged(open_.join(asked, "token").where((F.col("id") != F.col("a")) & near).select("a", F.col("id").alias("b")).distinct(), "asked")
        found.append(_verified(docs, classes, pairs))
        release(pairs)
    out = staged(_all(found).distinct(), "removed")
    release(*found, *leaders)
    return out


def _few(rows: DataFrame) -> DataFrame:
    """The rows, broadcast if they are few: the other side then stays where it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _postings(classes: DataFrame, gone: DataFrame) -> DataFrame:
    """key, id, the signatures a, b and wide, packed: prefix tokens of all classes.

    packed: the number n of tokens (28 bits) and the position p (28 bits), then whether the entry takes
    part as the shorter line, as the longer line, whether the class is open, i.e. not removed yet, and
    the sixteenth of the range of doc_ids that it is of, which rises with the order of lines.
    """
    low, high = classes.agg(F.min("first.doc_id"), F.max("first.doc_id")).first()
    share = (F.col("first.doc_id").cast("double") - float(low or 0)) / (float(high or 0) - float(low or 0) + 1)
    when = F.coalesce(F.least(F.lit(15), F.floor(16 * share)), F.lit(0)).cast("long")
    gone = gone.select("id", "id2", F.lit(False).alias("open"))
    band = lambda x: F.length(F.bin(x))
    each = classes.join(_few(gone), ["id", "id2"], "left").select("id", "n", "bits", "wide", when.alias("when"), F.coalesce("open", F.lit(True)).alias("open"), F.ceil(6 * F.col("n") / 7).alias("least"), band(F.col("n")).alias("own"), band(F.floor(4 * F.col("n") / 3)).alias("next"), "prefix")
    every = each.select("*", F.posexplode("prefix").alias("p", "token")).drop("prefix").withColumn("rank", F.shiftright("token", 32)).withColumn("short", F.col("p") <= F.col("n") - F.col("least"))
    yes, no, short, open_, own, next_ = F.lit(True), F.lit(False), F.col("short"), F.col("open"), F.col("own"), F.col("next")

    def entry(as_short: Column, as_long: Column, *key: Column) -> Column:
        return F.struct(F.xxhash64("token", *key).bitwiseAND(F.lit((1 << 40) - 1)).alias("key"), as_short.alias("short"), as_long.alias("long"))

    two = F.array(entry(yes, yes, own), entry(yes, no, next_))
    often = F.when(short & (own != next_), two).otherwise(F.array(entry(short, yes, own)))
    some = every.where(F.col("rank") < _rank(VERY_OFTEN)).withColumn("e", F.explode(F.when(F.col("rank") < _rank(OFTEN), F.array(entry(short, yes))).otherwise(often)))
    # lists of open classes as the longer lines, met by all shorter ones, and of removed ones, met by open ones
    hot = every.where(F.col("rank") >= _rank(VERY_OFTEN))
    long = hot.withColumn("e", entry(no, yes, own, open_))
    met = hot.where("short").withColumn("side", F.explode(F.when(open_, F.array(yes, no)).otherwise(F.array(yes))))
    met = met.withColumn("at", F.explode(F.when(own != next_, F.array(own, next_)).otherwise(F.array(own)))).withColumn("e", entry(yes, no, F.col("at"), F.col("side")))
    flags = F.shiftleft(F.col("e.short").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("e.long").cast("long"), 57)).bitwiseOR(F.shiftleft(open_.cast("long"), 58)).bitwiseOR(F.shiftleft("when", 59))
    packed = F.col("n").cast("long").bitwiseOR(F.shiftleft(F.col("p").cast("long"), 28)).bitwiseOR(flags)
    rows = [x.select("e.key", "id", "bits.a", "bits.b", "wide", packed.alias("packed")) for x in (some, long, met)]
    return rows[0].union(rows[1]).union(rows[2])


def _pairs(postings: DataFrame) -> DataFrame:
    """a, b: ids of classes that pass the filters, the later of them open, as far as the doc_ids' sixteenths tell."""
    x, y = postings.alias("x"), postings.alias("y")
    part = lambda side, at, mask: F.shiftright(F.col(f"{side}.packed"), at).bitwiseAND(F.lit(mask))
    low = (1 << 28) - 1
    n, m, p, q = part("x", 0, low), part("y", 0, low), part("x", 28, low), part("y", 28, low)
    # sides are told apart in conditions on both only, so that they stay one exchange
    flags = F.shiftright(F.col("x.packed"), 56).bitwiseAND(F.lit(1)) + F.shiftright(F.col("y.packed"), 57).bitwiseAND(F.lit(1)) == 2
    open_ = lambda side, other: (part(side, 58, 1) == 1) & (part(side, 59, 15) >= part(other, 59, 15))
    later_open = open_("x", "y") | open_("y", "x")
    order = (n < m) | ((n == m) & (F.col("x.id") < F.col("y.id")))
    room = F.least(p, q) + F.least(n - p, m - q)
    flipped = sum(F.bit_count(F.col(f"x.wide.{k}").bitwiseXOR(F.col(f"y.wide.{k}"))) for k in "abcd")
    near = _near(F.struct("x.a", "x.b"), F.struct("y.a", "y.b"), n, m) & F.coalesce(7 * flipped <= n + m, F.lit(True))
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & flags & order & near & (4 * n >= 3 * m) & later_open & (7 * room >= 3 * (n + m)))
    far = _flipped(F.struct("x.a", "x.b"), F.struct("y.a", "y.b")).cast("int")
    return joined.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), far.alias("far")).distinct()


def _later(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, id2 of the later classes of pairs that match.

    One match is enough: each class is compared with its nearest earlier candidate by signature, and
    with all others only if that fails, so a group of near copies takes about one comparison a class."""
    first = classes.select("id", "first")
    ordered = pairs.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    swap = F.col("x") > F.col("y")
    ordered = staged(ordered.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), "far"), "ordered")
    nearest = staged(ordered.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select("x.a", "b"), "nearest")
    found = _verified(docs, classes, nearest)
    rest = staged(ordered.select("a", "b").join(found.select(F.col("id").alias("b")), "b", "left_anti").join(nearest, ["a", "b"], "left_anti").select("a", "b"), "rest")
    out = staged(found.union(_verified(docs, classes, rest)), "found")
    release(ordered, nearest, rest, found)
    return out


def removed(docs: DataFrame) -> DataFrame:
    """id, id2, first of each class of lines, with ``gone`` if an earlier class matches it."""
    tokens = staged(_tokens(docs), "tokens")
    classes = staged(_classes(tokens), "classes")
    release(tokens)
    led = _led(docs, classes)
    total = classes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    parts = max(12, -(-total // PART))
    pairs = staged(_pairs(_postings(classes, led).repartition(parts, "key")), "pairs")
    gone = led.union(_later(docs, classes, pairs)).distinct().withColumn("gone", F.lit(True))
    out = staged(classes.select("id", "id2", "first").join(gone, ["id", "id2"], "left"), "removed")
    release(classes, led, pairs)
    return out


def _by_row(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_lines, removed (line numbers from 0, rising)."""
    classes = removed(docs).select("id", "id2", "first", "gone")
    rows = lines(docs).select("doc_id", "row", "line_no", "id", "id2").join(classes, ["id", "id2"], "left")
    out = F.col("gone") | (F.col("first").isNotNull() & ~F.struct("doc_id", "row", "line_no").eqNullSafe(F.col("first")))
    return rows.groupBy("doc_id", "row").agg((F.max("line_no") + 1).cast("long").alias("n_lines"), F.sort_array(F.collect_set(F.when(out, F.col("line_no")))).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, rising) of each doc_id and text."""
    return _by_row(docs).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_removed(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the removed lines."""
    found = _by_row(docs).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    joined = docs.join(found, docs.doc_id.eqNullSafe(found["_id"]) & (row(docs["text"]) == found["_row"]), "left")
    kept = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(found["_removed"], i))
    return joined.select(*(F.array_join(kept, "\n").alias("text") if c == "text" else docs[c] for c in docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS words FROM l),
u AS (SELECT words, min((doc_id, line_no)) AS first, row_number() OVER (ORDER BY words) AS id FROM w WHERE len(words) > 0 GROUP BY words),
t AS (SELECT id, len(words) AS n, unnest(words) AS x FROM u),
f AS (SELECT x, count(*) AS c FROM t GROUP BY x),
k AS (SELECT id, n, t.x FROM t JOIN f ON f.x = t.x QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, t.x) <= n // 4 + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.x = b.x AND a.id < b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
s AS (SELECT a, b, len(list_intersect(x.words, y.words)) AS c, len(x.words) + len(y.words) AS nm, x.first AS xf, y.first AS yf FROM p JOIN u x ON x.id = a JOIN u y ON y.id = b),
d AS (SELECT DISTINCT CASE WHEN xf > yf THEN a ELSE b END AS id FROM s WHERE 100 * c >= 75 * (nm - c)),
r AS (
  SELECT w.doc_id, w.line_no, len(w.words) > 0 AND (d.id IS NOT NULL OR (w.doc_id, w.line_no) <> u.first) AS gone
  FROM w LEFT JOIN u ON u.words = w.words LEFT JOIN d ON d.id = u.id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(list_sort(list(CAST(line_no AS INTEGER)) FILTER (gone)), []) AS removed FROM r GROUP BY doc_id
"""
