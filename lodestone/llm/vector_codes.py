"""Vector code compression: product codebooks trained by the filtering form of Lloyd's algorithm.

Vectors of whole numbers are cut into equal parts; each part position has a codebook.  Every
partition is cut into blocks of up to ``BLOCK`` vectors, and each block builds, once, one balanced
kd-tree a part position: boxes, counts and sums of all nodes, written with the vectors as rows of
a staged table.  A round walks the trees level by level.  For all open nodes at once the candidate
nearest to the box's middle is found, and a candidate goes that is farther from every point of the
box: its lead at the middle exceeds what any corner can make good.  A node with one candidate left
gives its cached sum and count to that entry as a whole; leaves compare their points with the
candidates left.  Tasks add up (entry, count, sums) over their blocks, so only codebooks pass
through the driver.  All of it is exact; ties go to the lower index.

Cases: null vectors and those with null or non-finite components are left out; so are those whose
length isn't that of the smallest vec_id whose length is a positive multiple of the number of parts.
An empty table gives no rows.  Rows without a vec_id come last among the starting entries; rows that
repeat one start in the order of their components, and all rows get a code.  Fewer vectors than
entries make smaller codebooks.  Null labels are one label.  Components whose squared distances
wouldn't fit a long raise ValueError.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adaptive_clusters import finite, matrix, whole
from .stage import release, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one block, points of a leaf at most, and nodes looked at together.
BLOCK, LEAF, NODES = 16384, 32, 256
#: Labels whose totals are sent to all executors; of more labels, those with over one in so many rows.
LABELS = 50_000
FREQUENT = 1000
_TREES = "vec_ids array<long>, labels array<long>, vectors binary, order binary, boxes binary, sums binary"
_SUMS = "part int, entry int, n long, sums array<long>"
_CODES = "vec_id long, label long, code string, error long"


class Tree:
    """A balanced kd-tree over rows of whole numbers, as arrays by level.  Node i of level l holds the
    points ``order[i * n >> l : (i + 1) * n >> l]``; its children are nodes 2 i and 2 i + 1 below."""

    def __init__(self, points: np.ndarray, order: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.boxes, self.sums = points, order, boxes, sums
        self.depth = depth(len(points))

    @staticmethod
    def ends(n: int, level: int) -> np.ndarray:
        return np.arange((1 << level) + 1) * n >> level

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n = len(points)
        order, boxes, sums = np.arange(n, dtype=np.int32), [], []
        for level in range(depth(n) + 1):
            ends = cls.ends(n, level)
            own = points[order]
            lo, hi = np.minimum.reduceat(own, ends[:-1]), np.maximum.reduceat(own, ends[:-1])
            boxes.append(np.stack([lo, hi], 1))
            sums.append(np.add.reduceat(own, ends[:-1]))
            if level < depth(n):  # each node is sorted along its widest side, and halved
                node = np.repeat(np.arange(1 << level), np.diff(ends))
                side = (hi - lo).argmax(1)
                order = order[np.lexsort((own[np.arange(n), side[node]], node))]
        return cls(points, order, np.concatenate(boxes), np.concatenate(sums))

    def assign(self, entries: np.ndarray, whole_nodes: Callable[[np.ndarray, int, np.ndarray], None], some: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Nearest entry of every point: ``whole_nodes(entry, level, node)`` for subtrees settled at once and
        ``some(entry, point)`` for points settled one by one."""
        n, k = len(self.points), len(entries)
        most = float(max(np.abs(self.boxes).max(), np.abs(entries).max()))
        dtype = np.float64 if 16.0 * most * most * entries.shape[1] < 2.0**53 else np.int64
        z = entries.astype(dtype)
        zz = (z * z).sum(1)
        apart = np.abs(z[:, None] - z[None])
        index = np.arange(k)
        node, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
        far = np.inf if dtype is np.float64 else np.iinfo(np.int64).max // 2
        for level in range(self.depth + 1):
            first = (1 << level) - 1
            for at in range(0, len(node), NODES):
                i = node[at : at + NODES]
                lo, hi = self.boxes[first + i, 0].astype(dtype), self.boxes[first + i, 1].astype(dtype)
                lead = np.where(alive[at : at + NODES], zz - (lo + hi) @ z.T, far)  # of a candidate, at the middle
                best = lead.argmin(1)
                gain = np.matmul(apart[best], (hi - lo)[:, :, None])[:, :, 0]  # what a corner makes good at most
                gap = lead - np.take_along_axis(lead, best[:, None], 1)
                alive[at : at + NODES] &= ~((gap > gain) | (gap == gain) & (index > best[:, None]))
            single = alive.sum(1) == 1
            whole_nodes(alive[single].argmax(1), level, node[single])
            node, alive = node[~single], alive[~single]
            if level < self.depth:
                node, alive = (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(alive, 2, 0)
        ends = self.ends(n, self.depth)
        for at in range(0, len(node), NODES):
            i, left = node[at : at + NODES], alive[at : at + NODES]
            use = np.flatnonzero(left.any(0))
            size = ends[i + 1] - ends[i]
            rank = np.repeat(np.arange(len(i)), size)
            point = self.order[np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size) + ends[i][rank]]
            d = zz[use] - 2 * (self.points[point].astype(dtype) @ z[use].T)
            some(use[np.where(left[rank][:, use], d, far).argmin(1)], point)

    def totals(self, entries: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
        """Adds each entry's number of points and their sum."""

        def whole_nodes(entry: np.ndarray, level: int, node: np.ndarray) -> None:
            ends = self.ends(len(self.points), level)
            np.add.at(count, entry, ends[node + 1] - ends[node])
            np.add.at(sums, entry, self.sums[(1 << level) - 1 + node])

        def some(entry: np.ndarray, point: np.ndarray) -> None:
            count[:] += np.bincount(entry, minlength=len(count))
            by = np.argsort(entry, kind="stable")
            first = np.flatnonzero(np.diff(entry[by], prepend=-1))
            if len(by):
                sums[entry[by][first]] += np.add.reduceat(self.points[point[by]], first)

        self.assign(entries, whole_nodes, some)

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point."""
        out = np.zeros(len(self.points), np.int64)

        def whole_nodes(entry: np.ndarray, level: int, node: np.ndarray) -> None:
            ends = self.ends(len(self.points), level)
            for e, i in zip(entry.tolist(), node.tolist(), strict=True):
                out[self.order[ends[i] : ends[i + 1]]] = e

        self.assign(entries, whole_nodes, lambda entry, point: out.__setitem__(point, entry))
        return out


def depth(n: int) -> int:
    """Levels below the root, so that leaves hold LEAF points at most and one at least."""
    return max(0, (-(-n // LEAF) - 1).bit_length())


def _plant(dims: int, parts: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of vectors with their trees."""
    width = dims // parts

    def block(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        trees = [Tree.build(x[:, p * width : (p + 1) * width]) for p in range(parts)]
        arrays = [x.astype("<i4"), np.stack([t.order for t in trees]).astype("<i4"), np.stack([t.boxes for t in trees]).astype("<i4"), np.stack([t.sums for t in trees]).astype("<i8")]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
            names=["vec_ids", "labels", "vectors", "order", "boxes", "sums"],
        )

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, n = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                b = batch.slice(lo, BLOCK)
                if n and n + b.num_rows > BLOCK:
                    yield block(ids, labels, np.concatenate(held))
                    ids, labels, held, n = [], [], [], 0
                ids += b.column("vec_id").to_pylist()
                labels += b.column("label").to_pylist()
                held.append(whole(matrix(b.column("embedding"), dims), scale))
                n += b.num_rows
        if n:
            yield block(ids, labels, np.concatenate(held))

    return f


def _planted(batch: pa.RecordBatch, i: int, dims: int, parts: int) -> tuple[np.ndarray, list[Tree]]:
    """The vectors and trees of a block."""
    raw = {c: batch.column(c)[i].as_buffer() for c in ("vectors", "order", "boxes", "sums")}
    x = np.frombuffer(raw["vectors"], "<i4").reshape(-1, dims).astype(np.int64)
    width = dims // parts
    order = np.frombuffer(raw["order"], "<i4").reshape(parts, -1)
    boxes = np.frombuffer(raw["boxes"], "<i4").reshape(parts, -1, 2, width).astype(np.int64)
    sums = np.frombuffer(raw["sums"], "<i8").reshape(parts, -1, width)
    return x, [Tree(x[:, p * width : (p + 1) * width], order[p], boxes[p], sums[p]) for p in range(parts)]


def _totals(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of one round: count and sums of each used entry over the task's blocks."""
    parts, k, width = books.shape

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, tree in enumerate(_planted(batch, i, parts * width, parts)[1]):
                    tree.totals(books[p], count[p], sums[p])
        p, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(sums[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists], names=["part", "entry", "n", "sums"])

    return f


def _codes(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, label, code and squared error of every vector."""
    parts, _, width = books.shape
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, trees = _planted(batch, i, parts * width, parts)
                error, code = np.zeros(len(x), np.int64), np.full(len(x), "", f"<U{2 * parts}")
                for p, tree in enumerate(trees):
                    c = tree.codes(books[p])
                    error += ((tree.points - books[p][c]) ** 2).sum(1)
                    code = np.char.add(code, hexes[c])
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return f


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector as a staged table, and the codebooks (part, entry, component)."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError("a code has two hexadecimal digits a part")
    spark = vectors.sparkSession
    rows = vectors.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & finite("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    first = [r["embedding"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], _CODES), np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0])
    rows = rows.where(F.size("embedding") == dims)
    if any(len(x) != dims for x in first):
        first = [r["embedding"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    books = whole(np.array(first, np.float64), scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    trees = staged(rows.mapInArrow(_plant(dims, parts, scale), _TREES), "code-trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_totals(books), _SUMS).select("part", "entry", "n", F.posexplode("sums"))
        for r in sums.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect():
            books[r["part"], r["entry"], r["pos"]] = r["s"] // r["n"]
    out = staged(trees.mapInArrow(_codes(books), _CODES), "codes")
    release(trees)
    return out, books


def decoded(found: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that its code stands for, in the units of the input."""
    parts = books.shape[0]
    flat = found.sparkSession.createDataFrame([([[[x / scale for x in e] for e in b] for b in books.tolist()],)], "books array<array<array<double>>>")
    vector = F.flatten(F.array(*(F.expr(f"books[{p}][CAST(conv(substr(code, {2 * p + 1}, 2), 16, 10) AS INT)]") for p in range(parts))))
    return found.crossJoin(F.broadcast(flat)).select("vec_id", vector.alias("vector"))


def with_label_error(found: DataFrame) -> DataFrame:
    """Adds the sum of errors over equal labels.  Few labels are sent to all executors; of many, only those with
    over one in FREQUENT rows (fewer than FREQUENT labels), so that no frequent label is joined in one task."""
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    if totals.count() <= LABELS:
        sent, rest = totals, None
    else:
        totals = staged(totals, "label-errors")
        least = totals.agg(F.sum("rows")).first()[0] / FREQUENT
        sent, rest = totals.where(F.col("rows") > least), totals.where(F.col("rows") <= least)

    def joined(rows: DataFrame, small: DataFrame) -> DataFrame:
        return rows.join(small.select(F.col("label").alias("_label"), "label_error"), F.col("label").eqNullSafe(F.col("_label")), "inner").select(*found.columns, "label_error")

    out = joined(found, F.broadcast(sent))
    if rest is not None:
        other = found.join(F.broadcast(sent.select(F.col("label").alias("_label"))), F.col("label").eqNullSafe(F.col("_label")), "left_anti")
        out = out.unionByName(joined(other, rest))
    return out


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round in turn, all distances: a plainer path.  A distance less the point's own square orders entries."""
    near = """SELECT r, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) + any_value(xx) AS d FROM (
  SELECT v.r, v.p, v.x, v.xx, b.e, b.xx - 2 * list_inner_product(v.y, b.y) AS d FROM v JOIN b{n} b ON b.p = v.p) GROUP BY r, p"""
    double = "list_transform(x, lambda z: CAST(z AS DOUBLE)) AS y, list_inner_product(list_transform(x, lambda z: CAST(z AS DOUBLE)), list_transform(x, lambda z: CAST(z AS DOUBLE))) AS xx"
    ctes = [
        f"""w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT *, {double} FROM (SELECT r, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x FROM w CROSS JOIN range({PARTS}) t(p)))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x, y, xx FROM v WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS):
        ctes.append(f"a{n} AS MATERIALIZED ({near.replace('{n}', str(n))})")
        ctes.append(f"""m{n} AS (SELECT p, e, i, sum(z)::HUGEINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS z, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT p, e, x, {double} FROM (SELECT b.p, b.e, coalesce(g.x, b.x) AS x FROM b{n} b LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{n} GROUP BY p, e) g ON g.p = b.p AND g.e = b.e))""")
    ctes.append(f"a{ROUNDS} AS MATERIALIZED ({near.replace('{n}', str(ROUNDS))})")
    ctes.append(f"f AS MATERIALIZED (SELECT w.vec_id, w.label, g.code, g.error FROM w JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r) g ON g.r = w.r)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM f"""


SQL = _sql()
