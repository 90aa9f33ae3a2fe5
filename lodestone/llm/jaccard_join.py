"""Exact n-gram Jaccard join with set-relation skipping.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct
5-word shingles.  The join is exact, whatever the order of frequencies found:

1.  Sets.  One pass hashes each text to its shingle set, gives the set a 64-bit id,
    and counts the shingles that repeat within a chunk of input.  Equal sets are one
    class from here on.
2.  Index.  Shingles are ordered by rarity: those that the counts show as frequent
    come last, by count; the rest by hash.  Two sets that link share at least
    1 + min(n, m) // 16 of their first n // 4 + 1 + n // 16 shingles (prefix filter
    with a count).  Posting lists are dealt out in packed blocks.
3.  Block skip.  A shared shingle at positions p and q leaves room for at most
    min(p, q) + min(n - p, m - q) common ones.  A list is ordered by position, and an
    entry meets only the block of those up to n / 3 positions behind it, beyond which
    there is no room for a link; the rest of the list is skipped unread.  Lists of up to
    ``SMALL`` entries give counted pairs; only pairs with the full count for their two
    lengths go on.
4.  Answer skip.  A longer list names one member as its hub, and members of lists with
    the same hub meet in that hub's group, in blocks of bounded size (sets with too few
    shared shingles for any link don't).  There the hub's overlaps are counted first, by
    lists of the group's own.  The overlaps of a highly similar set follow from the answered
    set's by the lists of their few different shingles alone.  A set already joined to
    another through answered links needs no answer of its own, so a group of near copies
    takes about one a block.  Sets of large groups that are left outside the group's main
    component are then compared with each block of the group.

Collision bound: ids and shingles are 64-bit hashes, so different sets share an id with
probability n^2 / 2^65 (under 1e-8 for 10^5 documents).  Intersections are counted on 48 bits:
a pair of sets of 1,000 shingles counts one too many with probability 4e-9.

Cases: nulls, empty texts and texts of white space have the empty set, n_shingles 0,
and are their own component.  Rows that repeat keep one result row each.  Rows whose
doc_id is null take part in links; a component's id is its smallest non-null doc_id
(null if it has none).  Further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components, with_few
from .stage import staged, table

WIDTH = 5
#: Shingles counted at a time in one task.
CHUNK = 1 << 20
#: A shingle that repeats within chunks this many times in all counts as frequent.
FREQUENT = 4
#: Most frequent shingles that are sent to the executors (16 MB); the order of further ones is by hash.
FREQUENT_MOST = 1 << 20
#: Postings in one block of the index, members of a group compared in one task at a time.
BUCKET = 1 << 20
GROUP = 1024
#: Answers of a group that are kept for others to be derived from.
ANSWERED = 32
#: Entries of a list that gives its pairs; a longer one gives a hub.
SMALL = 64
#: Pairs of entries looked at at a time.
PAIRS = 1 << 20
#: Bytes of each shingle of a set that is sent to a group.
SENT_BYTES = 6
#: Up to this many places of sets in groups (40 MB) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

_SETS = "doc_id long, n long, id long, gram long, times long"
_INDEX = "bucket long, block binary"
_FOUND = "kind int, id long, hub long, c long, need long"
PAIR, MEMBER, COUNT = 0, 1, 2


def _frame(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, set ids, sizes, values, offsets) of each piece of a batch of (doc_id, text)."""
    for lo, hi, raw, offs in K.pieces(batch.column(1)):
        values, ends = K.shingle_sets(raw, offs, WIDTH)
        yield np.arange(lo, hi), K.fingerprints(values, ends)[0], np.diff(ends), values, ends


def _hits(grams: np.ndarray) -> np.ndarray:
    hit = np.zeros(1 << 20, bool)
    hit[(grams & K.U((1 << 20) - 1)).astype(np.int64)] = True
    return hit


def _found(grams: np.ndarray, values: np.ndarray, hit: np.ndarray | None = None) -> np.ndarray:
    """Positions of the values that are among the sorted grams."""
    if not len(grams):
        return np.zeros(0, np.int64)
    hit = _hits(grams) if hit is None else hit
    maybe = np.flatnonzero(hit[(values & K.U((1 << 20) - 1)).astype(np.int64)])
    return maybe[grams[np.minimum(np.searchsorted(grams, values[maybe]), len(grams) - 1)] == values[maybe]]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    size, seen = 0, set()

    def repeats() -> pa.RecordBatch:
        v, owner = np.concatenate(held), np.concatenate(owners)
        u = np.sort(v)
        grams = np.unique(u[1:][u[1:] == u[:-1]])
        at = _found(grams, v)
        v, owner = v[at], owner[at]
        order = np.lexsort((K.mix(owner.view(np.uint64)), v))
        start = np.flatnonzero(np.diff(v[order], prepend=~v[order][:1]) != 0)
        times = np.diff(np.append(start, len(v)))
        none = pa.nulls(len(start), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(owner[order][start]), pa.array(v[order][start].view(np.int64)), pa.array(times)], names=["doc_id", "n", "id", "gram", "times"])

    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for rows, own, n, values, ends in _frame(batch):
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(n), pa.array(own), none, none], names=["doc_id", "n", "id", "gram", "times"])
            new = np.zeros(len(rows), bool)
            for i, x in enumerate(own.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            taken = np.repeat(new, n)
            held.append(values[taken])
            owners.append(np.repeat(own, n)[taken])
            size += len(held[-1])
            if size >= CHUNK:
                yield repeats()
                held, owners, size, seen = [], [], 0, set()
    if held:
        yield repeats()


def _prefix(n: np.ndarray) -> np.ndarray:
    return n // 4 + 1 + n // 16


def _need(n: np.ndarray) -> np.ndarray:
    """Fewest shared prefix shingles of a set in any link: for its smallest partner."""
    return 1 + -(-3 * n // 4) // 16


def _pair_need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fewest shared prefix shingles of a link between sets of n and m: common shingles that aren't in
    both prefixes come after the prefix that ends first, in its own set."""
    return np.maximum(1, -(-3 * (n + m) // 7) - np.maximum(n - _prefix(n), m - _prefix(m)))


def _narrow(local: np.ndarray, k: int) -> bytes:
    return local.astype(np.uint16 if k <= 1 << 16 else np.uint32).tobytes()


def _index(frequent, n_buckets: int):
    """Packed prefix postings.  A block: k; k set ids, k sizes; the low 32 bits of shingles, indexes of
    ids, positions.  Shingles that agree in a bucket and these bits only make more candidates."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ranks, hubs = frequent.value
        hit = _hits(grams)
        held: list[tuple[np.ndarray, ...]] = []
        direct: list[np.ndarray] = []
        size, seen = 0, set()

        def blocks() -> Iterator[pa.RecordBatch]:
            g, i, n, p = (np.concatenate(x) for x in zip(*held, strict=True))
            to = (K.mix(g ^ K.U(0x1234567)) % K.U(n_buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            starts = np.flatnonzero(np.diff(to[order], prepend=-1))
            names, out = [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(g)), strict=True):
                at = order[lo:hi]
                own, first, local = np.unique(i[at], return_index=True, return_inverse=True)
                names.append(int(to[at[0]]))
                out.append(b"".join(x.tobytes() for x in (np.array([len(own)], np.int64), own, n[at][first].astype(np.uint32), g[at].astype(np.uint32), np.minimum(p[at], 65535).astype(np.uint16))) + _narrow(local, len(own)))
            if direct:
                rows = np.concatenate(direct)
                to = (K.mix(rows[:, 0].view(np.uint64)) % K.U(n_buckets)).astype(np.int64)
                for b in np.unique(to):
                    names.append(-1 - int(b))
                    out.append(rows[to == b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for _, own, n, values, ends in _frame(batch):
                new = np.zeros(len(own), bool)
                for k, x in enumerate(own.tolist()):
                    if x not in seen and n[k]:
                        seen.add(x)
                        new[k] = True
                often = np.zeros(len(values), bool)
                often[_found(grams, values, hit)] = True
                doc = np.repeat(np.arange(len(own)), n)
                prefix = _prefix(n)
                rare = np.zeros(len(values) + 1, np.int64)
                np.cumsum(~often, out=rare[1:])
                place = rare[:-1] - rare[ends[:-1]][doc]
                take = np.flatnonzero(~often & (place < prefix[doc]) & new[doc])
                d = doc[take]
                held.append((values[take], own[d], n[d], place[take]))
                size += len(take)
                lack = prefix - (rare[ends[1:]] - rare[ends[:-1]])
                for k in np.flatnonzero((lack > 0) & new):
                    v = values[ends[k] : ends[k + 1]][often[ends[k] : ends[k + 1]]]
                    at = np.searchsorted(grams, v)
                    at = at[np.argsort(ranks[at])][: lack[k]]
                    hub, times = np.unique(hubs[at], return_counts=True)
                    direct.append(np.stack([np.full(len(hub), own[k]), hub, times, np.full(len(hub), n[k])], 1))
                    size += len(hub)
                if size >= CHUNK // 2:
                    yield from blocks()
                    held, direct, size, seen = [], [], 0, set()
        if held:
            yield from blocks()

    return f


def _counted(kind: int, id_: np.ndarray, hub: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (kind, id, hub, how often, need) of equal (id, hub)."""
    order = np.lexsort((hub, id_))
    id_, hub, need = id_[order], hub[order], need[order]
    start = np.flatnonzero(np.concatenate([[True], (id_[1:] != id_[:-1]) | (hub[1:] != hub[:-1])])) if len(id_) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(id_)))
    return np.full(len(start), kind, np.int32), id_[start], hub[start], times, need[start]


def _hubs(t: pa.Table) -> pa.Table:
    """Counted pairs, members of hubs' groups and counts of shared shingles from one block of the index."""
    names = ["kind", "id", "hub", "c", "need"]
    if t.num_rows and t.column("bucket")[0].as_py() < 0:
        p = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(-1, 4) for x in t.column("block")])
        _, once = np.unique(np.stack([p[:, 0].view(np.uint64), p[:, 1].view(np.uint64)], 1), axis=0, return_index=True)
        p = p[once]
        return pa.table([np.full(len(p), MEMBER, np.int32), p[:, 0], p[:, 1], p[:, 2], _need(p[:, 3])], names=names)
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for x in t.column("block"):
        b = x.as_py()
        k = int(np.frombuffer(b, np.int64, 1)[0])
        wide = 2 if k <= 1 << 16 else 4
        m = (len(b) - 8 - 12 * k) // (6 + wide)
        at = 8 + 12 * k
        local = np.frombuffer(b, np.uint16 if wide == 2 else np.uint32, m, at + 6 * m)
        columns[0].append(np.frombuffer(b, np.uint32, m, at))
        columns[1].append(np.frombuffer(b, np.int64, k, 8)[local])
        columns[2].append(np.frombuffer(b, np.uint32, k, 8 + 8 * k)[local].astype(np.int64))
        columns[3].append(np.frombuffer(b, np.uint16, m, at + 4 * m).astype(np.int64))
    g, i, n, p = (np.concatenate(x) for x in columns)
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    order = shared[np.lexsort((K.mix(i[shared].view(np.uint64)), g[shared]))]
    once = np.ones(len(order), bool)
    once[1:] = (g[order][1:] != g[order][:-1]) | (i[order][1:] != i[order][:-1])
    g, i, n, p = (x[order[once]] for x in (g, i, n, p))
    if not len(g):
        return pa.table([np.zeros(0, np.int32)] + [np.zeros(0, np.int64)] * 4, names=names)
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    length = np.diff(np.append(start, len(g)))
    size = np.repeat(length, length)
    hub = np.repeat(i[start], length)
    small, large = (size > 1) & (size <= SMALL), size > SMALL
    lists = np.repeat(np.arange(len(start)), length)
    at = np.flatnonzero(small)
    at = at[np.lexsort((p[at], lists[at]))]
    reach = np.searchsorted((lists[at] << 17) + p[at], (lists[at] << 17) + np.minimum(p[at] + n[at] // 3, 65535), "right")
    many = reach - np.arange(len(at)) - 1
    done = np.append(0, np.cumsum(many))
    pairs: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(lo, hi), many[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(done[lo:hi] - done[lo], many[lo:hi])
        a, b = at[x], at[y]
        room = np.minimum(p[a], p[b]) + np.minimum(n[a] - p[a], n[b] - p[b])
        far = (7 * room < 3 * (n[a] + n[b])) & (p[a] < 65535) & (p[b] < 65535)
        far |= (4 * np.minimum(n[a], n[b]) < 3 * np.maximum(n[a], n[b]))
        a, b = a[~far], b[~far]
        pairs.append((np.minimum(i[a], i[b]), np.maximum(i[a], i[b]), _pair_need(n[a], n[b])))
        lo = hi
    rows = [
        _counted(PAIR, *(np.concatenate(x) for x in zip(*pairs, strict=True))),
        _counted(MEMBER, i[large], hub[large], _need(n[large])),
        _counted(COUNT, i[small], np.zeros(int(small.sum()), np.int64), _need(n[small])),
    ]
    return pa.table([np.concatenate(x) for x in zip(*rows, strict=True)], names=names)


_SENT = "hub long, block int, part int, label long, asks boolean, id long, grams binary"


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group that a set goes to; of rows that repeat a text, one goes."""
    seen: set[int] = set()
    for batch in batches:
        wanted, groups = batch.column(1).to_numpy(), batch.column(2)
        for lo, _, raw, offs in K.pieces(batch.column(0)):
            values, ends = K.shingle_sets(raw, offs, WIDTH)
            own = K.fingerprints(values, ends)[0]
            out: list[dict] = []
            for k in np.flatnonzero(own == wanted[lo : lo + len(own)]):
                if int(own[k]) not in seen:
                    seen.add(int(own[k]))
                    grams = values[ends[k] : ends[k + 1]].view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES].tobytes()
                    out += [g | {"id": int(own[k]), "grams": grams} for g in groups[lo + k].as_py()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SENT_TYPES)


_SENT_TYPES = pa.schema([(a, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[b]) for a, b in (x.split() for x in _SENT.split(", "))])


def answer(sets: list[np.ndarray], labels: np.ndarray, queries: np.ndarray | None = None, percent: int = 75) -> list[tuple[int, int]]:
    """Links that join the components which all links of these sets make.

    labels: components known before.  queries: positions to be compared with all
    (else every set).  A set's answer holds sets outside its component and within the
    length filter.
    """
    k = len(sets)
    size = np.array([len(x) for x in sets])
    bounds = np.append(0, np.cumsum(size))
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(k), size)[by]
    first = np.append(0, np.cumsum(np.bincount(ids, minlength=len(vocabulary))))
    comp = labels.copy()
    links: list[tuple[int, int]] = []
    left = np.ones(k, bool) if queries is None else np.isin(np.arange(k), queries)
    answered: list[tuple[int, np.ndarray]] = []

    def tally(elements: np.ndarray) -> np.ndarray:
        """How many of these shingles each set has, from the shingles' lists."""
        n = first[elements + 1] - first[elements]
        at = np.repeat(first[elements] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=k)

    def overlaps(x: int) -> np.ndarray:
        """The sizes of all intersections with set x, from a similar answered set's where there is one."""
        mine = ids[bounds[x] : bounds[x + 1]]
        base, known = max(answered, key=lambda t: t[1][x], default=(x, None))
        if known is not None and 2 * (size[x] + size[base] - 2 * known[x]) < size[x]:
            other = ids[bounds[base] : bounds[base + 1]]
            return known + tally(np.setdiff1d(mine, other, True)) - tally(np.setdiff1d(other, mine, True))
        common = tally(mine)
        if len(answered) < ANSWERED:
            answered.append((x, common))
        return common

    x = 0 if queries is None else (int(queries[0]) if len(queries) else -1)
    while x >= 0:
        left[x] = False
        others = np.flatnonzero((comp != comp[x]) & (100 * size >= percent * size[x]) & (percent * size <= 100 * size[x]))
        if len(others):
            common = overlaps(x)[others]
            for o in others[100 * common >= percent * (size[x] + size[others] - common)]:
                if comp[o] != comp[x]:
                    comp[comp == comp[o]] = comp[x]
                    links.append((x, int(o)))
        open_ = np.flatnonzero(left)
        if len(open_) and queries is None:
            names, counts = np.unique(comp, return_counts=True)
            open_ = open_[comp[open_] != names[np.argmax(counts)]]
        x = int(open_[0]) if len(open_) else -1
    return links


def _grams(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SENT_BYTES, 8), np.uint8)
    out[:, :SENT_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SENT_BYTES)
    return out.view(np.uint64)[:, 0]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.ones(batch.num_rows, bool)
        cut[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = np.flatnonzero(cut)
        for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _answers(keys: list[str]):
    """Links of each group of (keys, id, label, asks, grams) rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for t in _runs(batches, keys):
            ids = t.column("id").to_numpy()
            _, first = np.unique(ids, return_index=True)
            asks = t.column("asks").to_numpy(zero_copy_only=False)
            if len(first) > 1:
                sets = [_grams(t.column("grams")[int(j)].as_py()) for j in first]
                own = ids[first]
                asking = np.array([asks[ids == x].any() for x in own]) if keys[-1] == "part" else None
                hub = np.flatnonzero(own == t.column("hub")[0].as_py())
                order = np.arange(len(own))
                if len(hub):
                    order[0], order[hub[0]] = order[hub[0]], order[0]
                label = t.column("label").to_numpy()[first]
                for a, b in answer([sets[j] for j in order], label[order], None if asking is None else np.flatnonzero(asking[order])):
                    u.append(int(own[order[a]]))
                    v.append(int(own[order[b]]))
            if len(u) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return f


def _send(docs: DataFrame, reps: DataFrame, placed: DataFrame) -> DataFrame:
    """Each placed set with its shingles: texts of the classes' first documents are read and hashed again."""
    groups = placed.groupBy("id").agg(F.collect_list(F.struct("hub", "block", "part", "label", "asks")).alias("groups"))
    want = staged(groups.join(reps, "id").select(F.col("doc_id").alias("_want"), F.col("id"), "groups"), "wanted")
    size = want.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0))).first()[0]
    want = F.broadcast(want) if size <= BROADCAST_ROWS else want.hint("shuffle_hash")
    return docs.join(want, docs.doc_id.eqNullSafe(want["_want"])).select("text", "id", "groups").mapInArrow(_sent, _SENT)


def _in_groups(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_answers(keys), "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = staged(docs.mapInArrow(_sets, _SETS), "sets")
    rows = made.where("gram is null").select("doc_id", "n", "id")
    counted = made.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"), F.min_by("id", F.xxhash64("id")).alias("id")).where(F.col("times") >= FREQUENT)
    top = counted.orderBy(F.desc("times"), "gram").limit(FREQUENT_MOST).toArrow()
    grams = top.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    times = top.column("times").to_numpy()[order]
    hubs = top.column("id").to_numpy()[order]
    total, = made.where("gram is null").select(F.coalesce(F.sum(F.expr("n div 4 + 1 + n div 16")), F.lit(0))).first()
    frequent = spark.sparkContext.broadcast((grams[order], np.lexsort((grams[order], times)).argsort(), hubs))
    buckets = max(12, -(-total // BUCKET))
    index = docs.mapInArrow(_index(frequent, buckets), _INDEX)
    found = index.groupBy("bucket").applyInArrow(_hubs, _FOUND)
    found = staged(found.groupBy("kind", "id", "hub").agg(F.sum("c").alias("c"), F.max("need").alias("need")), "found")
    enough = found.where(F.col("kind") != PAIR).groupBy("id").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("id")
    members = staged(found.where(F.col("kind") == MEMBER).select("id", "hub").join(enough, "id"), "members")
    count = members.groupBy("hub").agg(F.count("*").alias("k"))
    large = staged(count.where(F.col("k") > GROUP).select("hub", F.expr(f"cast(ceil(k / {GROUP}) as int)").alias("blocks")), "large")
    pairs = found.where((F.col("kind") == PAIR) & (F.col("c") >= F.col("need"))).select("id", "hub")
    named = members.join(count.where("k = 1").select("hub"), "hub", "left_anti").select("id", "hub").union(pairs).distinct()
    named = staged(named, "named")
    least = rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("d"))
    reps = staged(least.drop("d").join(named.select("id").union(named.select("hub")).distinct(), "id", "left_semi"), "reps")
    parts = max(12, -(-total // (2 << 20)))
    placed = (
        named.join(large, "hub", "left")
        .withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
        .select("id", "hub", "block")
    )
    centre = named.select("hub").distinct().join(large, "hub", "left").select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    first = placed.union(centre).select("id", "hub", "block", F.lit(0).alias("part"), F.col("id").alias("label"), F.lit(True).alias("asks"))
    links = staged(_in_groups(_send(docs, reps, first), ["hub", "block"], parts), "links")

    if large.limit(1).count():
        known = connected_components(links)
        inside = staged(
            placed.join(large, "hub").join(known.withColumnRenamed("node", "id"), "id", "left")
            .select("id", "hub", "block", "blocks", F.coalesce("root", "id").alias("label")), "inside")
        main = inside.groupBy("hub", "label").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
        outside = inside.join(main, "hub").where("label <> main")
        ask = outside.select("id", "hub", "label", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("block").alias("part"))
        asked = outside.select("hub", F.col("block").alias("part")).distinct()
        told = inside.join(asked, "hub").select("id", "hub", "label", F.lit(False).alias("asks"), "block", "part")
        second = _send(docs, reps, ask.unionByName(told))
        links = staged(links.union(_in_groups(second, ["hub", "block", "part"], parts)), "links")

    roots = connected_components(links).withColumnRenamed("node", "id")
    joined = roots.join(least.drop("d"), "id")
    named_roots = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = joined.join(named_roots, "root").select("id", "component_id")
    every = staged(least.join(linked, "id", "left").select("id", F.coalesce("component_id", "doc_id").alias("component_id"), "d"), "every")
    some = with_few(rows.where("n > 0"), every, "id", rows.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the row whose doc_id names it.

    Rows that share a kept doc_id are repeats of it, and one of them stays.  Rows
    without a doc_id can't be told apart and stay.
    """
    found = staged(classes(docs), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")
    ids = found.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    return kept if ids[0] == ids[1] else kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
t AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
g AS (
  SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS gram
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (
  SELECT DISTINCT doc_id, gram FROM g WHERE gram IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
s AS (SELECT w.doc_id, count(gram) AS n FROM w LEFT JOIN e ON e.doc_id = w.doc_id GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * common >= 75 * (a.n + b.n - common)),
both_ways AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT node, v FROM r JOIN both_ways ON seen = u),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id FROM s JOIN c ON node = doc_id
"""
