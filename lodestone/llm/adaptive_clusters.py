"""Centroid clustering in whole numbers with Drake's adaptive bounds.

Each vector carries, from round to round, its centroid with an upper bound of that
distance, lower bounds of its ``b`` next nearest centroids, and one lower bound for all
the rest.  A round moves the bounds by how far centroids went and looks at distances only
where the order isn't certain any more: first at the own centroid, then at the stored ones
within reach, then at all (a rescan, which stores the nearest anew).  ``b`` starts at a
quarter of the centroids and shrinks to the most that any vector needed, an eighth at least.

Distances are exact integers; bounds are doubles with a margin far above their rounding, and
an order is certain only where it is strict, so ties always come to exact comparison (the
smaller number wins).  A round is one pass over a staged table; tasks add partial sums as rows
of their own, so only centroids (k times the components) pass through the driver.

Cases: vectors that are null, of another length, or with null or non-finite components are
left out; an empty table gives no rows.  Repeated rows are vectors of their own.  Fewer vectors
than centroids make as many centroids as vectors.  Rows without a vec_id start no centroid, unless
there are too few others.  Rows with the same vec_id start in the order of their components.
Components whose squared distances wouldn't fit a long raise ValueError.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import release, staged, table

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Relative margin of bounds.
MARGIN = 1e-12
_STATE = "vec_id long, v array<int>, cluster int, distance long, upper double, near array<int>, lower array<double>, rest double, n long, sums array<long>, needed int"


def finite(vector: str) -> Column:
    """The vector isn't null and has no null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as 64-bit integers; ValueError where squared distances may not fit."""
    y = np.floor(x.astype(np.float64) * scale)
    if y.size and np.abs(y).max() * 2 * np.sqrt(x.shape[1]) >= 2.0**31:
        raise ValueError("a component is too large for squared distances in a long")
    return y.astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def all_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, exact."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    dtype = np.float64 if 4.0 * most * most * x.shape[1] < 2.0**53 else np.int64
    p, q = x.astype(dtype), c.astype(dtype)
    return ((p * p).sum(1)[:, None] - 2 * (p @ q.T) + (q * q).sum(1)).astype(np.int64)


def up(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


def down(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


class Bounds:
    """What is known of a batch's vectors: centroid, upper bound, b stored centroids with lower bounds, bound of the rest."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.cluster, self.upper, self.near, self.lower, self.rest = cluster, upper, near, lower, rest

    @classmethod
    def empty(cls, n: int, b: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.zeros(n), np.zeros((n, b), np.int32), np.zeros((n, b)), np.zeros(n))

    def moved(self, drift: np.ndarray) -> None:
        """Centroids went so far: their distances are known that much worse."""
        self.upper += drift[self.cluster]
        self.lower -= drift[self.near]
        self.rest -= drift.max(initial=0)

    def rescan(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray) -> None:
        """All distances of some rows; the nearest are stored."""
        b = self.near.shape[1]
        d2 = all_distances(x[rows], c)
        order = np.argsort(d2, 1, kind="stable")[:, : b + 2]
        d2 = np.take_along_axis(d2, order, 1)
        self.cluster[rows], self.upper[rows] = order[:, 0], up(d2[:, 0])
        self.near[rows], self.lower[rows] = order[:, 1 : b + 1], down(d2[:, 1 : b + 1])
        self.rest[rows] = down(d2[:, b + 1]) if d2.shape[1] > b + 1 else np.inf

    def settle(self, x: np.ndarray, c: np.ndarray) -> int:
        """Makes every cluster the exact nearest; returns the most stored bounds a row needed."""
        low = np.minimum(self.lower.min(1, initial=np.inf), self.rest)
        rows = np.flatnonzero(self.upper >= low)
        own = ((x[rows] - c[self.cluster[rows]]) ** 2).sum(1)
        self.upper[rows] = up(own)
        still = self.upper[rows] >= low[rows]
        rows, own = rows[still], own[still]
        if not len(rows):
            return 0
        # the stored centroids within reach, exactly
        r, j = np.nonzero(self.lower[rows] <= self.upper[rows, None])
        near = self.near[rows]
        far = np.iinfo(np.int64).max
        d2 = np.full(near.shape, far)
        d2[r, j] = ((x[rows[r]] - c[near[r, j]]) ** 2).sum(1)
        lower = self.lower[rows]
        lower[r, j] = down(d2[r, j])
        every = np.concatenate([own[:, None], d2], 1)
        names = np.concatenate([self.cluster[rows][:, None], near], 1)
        best = every.min(1)
        choice = np.where(every == best[:, None], names, c.shape[0]).argmin(1)
        at = np.flatnonzero(choice)
        swapped = self.cluster[rows[at]]
        self.cluster[rows] = names[np.arange(len(rows)), choice]
        near[at, choice[at] - 1], lower[at, choice[at] - 1] = swapped, down(own[at])
        self.near[rows], self.lower[rows], self.upper[rows] = near, lower, up(best)
        needed = int(np.bincount(r, minlength=1).max())
        unsure = rows[self.upper[rows] >= self.rest[rows]]
        if len(unsure):
            self.rescan(unsure, x, c)
            needed = near.shape[1]
        return needed

    def cut(self, b: int) -> None:
        """Keep the b smallest lower bounds; the others go into the bound of the rest."""
        order = np.argsort(self.lower, 1, kind="stable")
        near, lower = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.lower, order, 1)
        self.rest = np.minimum(self.rest, lower[:, b:].min(1, initial=np.inf))
        self.near, self.lower = near[:, :b], lower[:, :b]


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).ravel(), kind))


def _round(centroids: np.ndarray, drift: np.ndarray | None, b: int, scale: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task of one round: rows with new clusters and bounds, then a row a cluster with count and sums
    (in the last round with the sum of squared distances).  Without a drift there are no bounds yet."""
    k, dims = centroids.shape
    names = [f.split()[0] for f in _STATE.split(", ")]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, needed = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        inertia = np.zeros(k, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if drift is None:
                x = whole(matrix(batch.column("embedding"), dims), scale)
                state = Bounds.empty(n, b)
                state.rescan(np.arange(n), x, centroids)
            else:
                x = matrix(batch.column("v"), dims).astype(np.int64)
                num = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "rest")}
                stored = len(batch.column("near").flatten()) // n
                state = Bounds(num["cluster"], num["upper"], matrix(batch.column("near"), stored).copy(), matrix(batch.column("lower"), stored).copy(), num["rest"])
                state.moved(drift)
                needed = max(needed, state.settle(x, centroids))
                state.cut(b)
            member = np.zeros((k, n), np.float64)
            member[state.cluster, np.arange(n)] = 1
            counts += np.bincount(state.cluster, minlength=k)
            part = np.zeros((k, dims), np.int64)
            if np.abs(x).max() * float(n) < 2.0**53:
                part = (member @ x.astype(np.float64)).astype(np.int64)
            else:
                np.add.at(part, state.cluster, x)
            sums += part
            out = {"vec_id": batch.column("vec_id"), "cluster": pa.array(state.cluster, pa.int32())}
            if last:
                d2 = ((x - centroids[state.cluster]) ** 2).sum(1)
                np.add.at(inertia, state.cluster, d2)
                out["distance"] = pa.array(d2)
            else:
                out |= {"v": _lists(x, pa.int32()), "upper": pa.array(state.upper), "near": _lists(state.near, pa.int32()), "lower": _lists(state.lower, pa.float64()), "rest": pa.array(state.rest)}
            yield _batch(out, n, names)
        totals = {"cluster": pa.array(np.arange(k), pa.int32()), "n": pa.array(counts), "sums": _lists(sums, pa.int64()), "needed": pa.array([needed] * k, pa.int32())}
        yield _batch(totals | ({"distance": pa.array(inertia)} if last else {}), k, names)

    return f


_TYPES = {"vec_id": pa.int64(), "v": pa.list_(pa.int32()), "cluster": pa.int32(), "distance": pa.int64(), "upper": pa.float64(), "near": pa.list_(pa.int32()), "lower": pa.list_(pa.float64()), "rest": pa.float64(), "n": pa.int64(), "sums": pa.list_(pa.int64()), "needed": pa.int32()}


def _batch(columns: dict[str, pa.Array], n: int, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, _TYPES[c]) for c in names], names=names)


def starts(vectors: DataFrame, k: int, seed: int, scale: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "embedding").limit(k).collect()
    return whole(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dims), scale)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[dict]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids with count and inertia."""
    spark = vectors.sparkSession
    rows = vectors.where((F.size("embedding") == dims) & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = starts(rows, k, seed, scale, dims)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    b, drift, state = min(max(k // 4, 1), k - 1), None, None
    for n in range(rounds + 1):
        task = _round(centroids, drift, b, scale, n == rounds)
        after = staged((rows if state is None else state.where("n IS NULL")).mapInArrow(task, _STATE), f"clusters-{n}")
        totals = after.where("n IS NOT NULL").select("cluster", "n", "distance", "needed", F.posexplode("sums")).groupBy("cluster", "pos").agg(
            F.sum("n").alias("n"), F.sum("col").alias("s"), F.max("needed").alias("needed"), F.sum("distance").alias("inertia")).collect()
        if state is not None:
            release(state)
        state = after
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        inertia = [0] * k
        for r in totals:
            count[r["cluster"]], sums[r["cluster"], r["pos"]], inertia[r["cluster"]] = r["n"], r["s"], r["inertia"]
        if n < rounds:
            new = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)
            if n:
                b = max(min(b, max(r["needed"] for r in totals)), min(max(k // 8, 1), k - 1))
            drift, centroids = up(((new - centroids) ** 2).sum(1)), new
    info = [{"cluster": c, "n": int(count[c]), "inertia": int(inertia[c] or 0), "centroid": centroids[c].tolist()} for c in range(k)]
    return state.where("n IS NULL").select("vec_id", "cluster", "distance"), info


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, info = clusters(table(spark, sf_dir, "embeddings"))
    total = sum(x["inertia"] for x in info)
    digest = [(x["cluster"], x["inertia"], total, hashlib.sha256(",".join(map(str, x["centroid"])).encode()).hexdigest()) for x in info]
    each = spark.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Every round in turn, all distances: a plainer path."""
    square = "list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = "SELECT v.r, v.vec_id, v.x, min({d}) AS distance, arg_min(c.c, ({d}, c.c)) AS cluster FROM v CROSS JOIN c{n} c GROUP BY ALL".replace("{d}", square.format(x="v.x", y="c.x"))
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for n in range(ROUNDS):
        ctes.append(f"a{n} AS MATERIALIZED ({near.replace('{n}', str(n))})")
        ctes.append(f"""m{n} AS (SELECT cluster, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(g.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{n} GROUP BY cluster) g ON g.cluster = c.c)""")
    ctes.append(f"a{ROUNDS} AS MATERIALIZED ({near.replace('{n}', str(ROUNDS))})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.c = cluster"""


SQL = _sql()
