"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document leaks an item if some run of its words is within ``n // 4`` word edits of
the item's n words.  Words are runs of letters, digits and non-ASCII bytes with A-Z
lower-cased.

1.  Windows.  Every position of every text starts a window of each item size.  Windows
    that can't hold a leak are left out by a bound without loss: an edit breaks at most
    two of an item's n - 1 word pairs, so a leak within n // 4 edits keeps
    n - 1 - 2 * (n // 4) of them (one prefix sum over pairs that some item has).
2.  Embedding.  The CGK walk copies the current word at each step and moves on where a
    random bit of (step, word) is set, which maps few edits to few mismatches.  Of its
    3 n steps the first n are made; walks that have parted rarely meet again later.
3.  LSH.  Each table samples ``m`` steps; m and the number of tables are fitted, by item
    size, so that copies of the items with n // 4 random edits (changes, inserts, drops)
    meet with a mean probability of ``RECALL``.  A size that no number of tables up to
    ``TABLES_MOST`` serves has all its filtered windows verified.
4.  Each candidate is verified by the exact edit distance of the item to the best run of
    words around the window, walk by walk: windows within n // 2 of a verified leak, once
    it and items like it have been searched for around all of them, take no further walks.

The items travel to every executor; above ``ITEM_WORDS`` words they are taken in several
passes.  Everything runs where the text is read: no shuffle of texts, and only leaks leave.

Cases: null or empty texts and items leak nothing; items of fewer than ``MIN_WORDS`` words
leak by exact copies only, which are searched in every document.  Items with the same words each give their own rows.
Rows that repeat a doc_id are searched each; a pair is reported once, with the least
distance, then the earliest start.  Rows with a null doc_id are reported under null.  An
empty table or benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .stage import table

MIN_WORDS = 8
RECALL = 0.97
#: With more tables than this a table samples fewer steps; where one step needs more, every window of the filter is verified.
TABLES_MOST = 192
#: Edited copies of a size's items, and walks of each, that tables are fitted to.
FITTED = 400
WALKS_TRIED = 16
STEPS = 1
TABLES_OF_WALK = 12
#: Words of items held by an executor at a time (about 100 MB with their tables).
ITEM_WORDS = 1 << 20
#: Words of suspected documents embedded together in a task.
HELD_WORDS = 1 << 20
_LEAKS = "doc_id long, item_id long, distance int, start_word long, n_words int"


def item_words(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, raw, offs in K.pieces(texts):
        w = K.Words(raw, offs, K.LOWER, K.NOT_ALNUM)
        h = w.hashes
        out += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def embed(words: np.ndarray, starts: np.ndarray, n: int, seed: int, end: np.ndarray | None = None) -> np.ndarray:
    """CGK walks of the windows words[s : s + n], a row each; 0 after a window's end or the document's."""
    at = np.zeros(len(starts), np.int64)
    out = np.zeros((len(starts), STEPS * n), K.U)
    limit = np.minimum(n, (len(words) if end is None else end) - starts)
    for j in range(STEPS * n):
        live = at < limit
        c = words[np.minimum(starts + at, len(words) - 1)]
        out[live, j] = c[live]
        at += live & (K.mix(c + K.U(seed * 1_000_003 + j)) & K.U(1)).astype(bool)
    return out


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of words nearest to the item; the shortest distance, then the earliest end."""
    m = len(words)
    row = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    idx = np.arange(m + 1)
    for i, c in enumerate(item):
        diag, up = row[:-1] + (words != c), row[1:] + 1
        new = np.empty(m + 1, np.int64)
        start = np.empty(m + 1, np.int64)
        new[0], start[0] = i + 1, 0
        new[1:] = np.minimum(diag, up)
        start[1:] = np.where(diag <= up, origin[:-1], origin[1:])
        slack = new - idx
        best = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == best, idx, 0))  # the last place that sets the running minimum
        row, origin = best + idx, start[source]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return K.mix(words[:-1] * K.U(3) + words[1:])


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = max(0, len(words) - n + 1)
    out = words[:m]
    for i in range(1, n):
        out = K.mix(out * K.U(31) + words[i : m + i])
    return out


class Index:
    """Items, the filter of their word pairs, and LSH tables by item size."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray], seed: int = 7):
        self.ids = [i for i, w in zip(ids, words, strict=True) if len(w) >= MIN_WORDS]
        self.words = [w for w in words if len(w) >= MIN_WORDS]
        self.short_ids = [i for i, w in zip(ids, words, strict=True) if 0 < len(w) < MIN_WORDS]
        self.short_words = [w for w in words if 0 < len(w) < MIN_WORDS]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.short_words}):
            own = np.array([k for k, w in enumerate(self.short_words) if len(w) == n])
            key = np.concatenate([run_hashes(self.short_words[k], n) for k in own])
            order = np.argsort(key, kind="stable")
            self.short[n] = key[order], own[order]
        self.plan = self._fit(seed)
        self.pairs = np.unique(np.concatenate([pair_hashes(w) for w in self.words])) if self.words else np.zeros(0, K.U)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words}):
            own = np.array([k for k, w in enumerate(self.words) if len(w) == n])
            flat = np.concatenate([self.words[k] for k in own])
            key = np.concatenate([np.zeros(0, K.U), *(sig for _, sig in self._signatures(flat, np.arange(len(own)) * n, n))])
            order = np.argsort(key, kind="stable")
            pairs = np.append(np.isin(self.pairs, np.concatenate([pair_hashes(self.words[k]) for k in own])), False)
            self.sizes[n] = (pairs, key[order], np.tile(own, self.plan[n][1])[order])

        self.own_pairs = [set(pair_hashes(w).tolist()) for w in self.words]
        self.having: dict[int, dict[int, list[int]]] = {n: {} for n in self.sizes if not self.plan[n][1]}
        for k, w in enumerate(self.words):
            if len(w) in self.having:
                for x in self.own_pairs[k]:
                    self.having[len(w)].setdefault(x, []).append(k)
        self.alike: list[list[int]] = self._alike()

    def _alike(self) -> list[list[int]]:
        """Of each item, the others that share a third of the pairs a leak of them must keep."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            for x in set(pair_hashes(w).tolist()):
                by.setdefault(x, []).append(k)
        out = []
        for k, w in enumerate(self.words):
            shared: dict[int, int] = {}
            for x in set(pair_hashes(w).tolist()):
                for o in by[x]:
                    shared[o] = shared.get(o, 0) + 1
            out.append([o for o, c in shared.items() if o != k and 3 * c >= len(self.words[o]) - 1 - 2 * (len(self.words[o]) // 4)])
        return out

    def _fit(self, seed: int) -> dict[int, tuple[int, int]]:
        """Sampled steps a table, and tables for the target recall, by item size; 0 tables where ``TABLES_MOST`` don't
        reach it, so that every window of the filter is verified.

        ``FITTED`` edited copies of a size's items are embedded by ``WALKS_TRIED`` walks each.  Tables of a walk meet
        together where the walk stays in step, so a copy is missed by a walk with the mean over its walks."""
        rng = np.random.default_rng(seed)
        out = {}
        for n in sorted({len(w) for w in self.words}):
            own = [w for w in self.words if len(w) == n]
            which = np.resize(rng.permutation(len(own)), FITTED)
            copies = []
            for k in which:
                w = own[k].tolist()
                for _ in range(n // 4):
                    how, at = rng.integers(3), int(rng.integers(len(w)))
                    w[at : at + (how < 2)] = [int(rng.integers(1 << 62))] * int(how > 0)  # drop, change, insert
                copies += (w + [int(rng.integers(1 << 62)) for _ in range(n)])[: 3 * n // 2]
            items, edited = np.concatenate([own[k] for k in which]), np.array(copies, K.U)
            at = np.arange(FITTED)
            same = np.stack([(embed(items, at * n, n, s) == embed(edited, at * (3 * n // 2), n, s)).mean(1) for s in range(WALKS_TRIED)])
            out[n] = (1, 0)
            for m in (4, 3, 2, 1):
                missed = ((1 - same**m) ** TABLES_OF_WALK).mean(0)  # by the tables of a walk, of each copy
                walks = next((w for w in range(1, TABLES_MOST // TABLES_OF_WALK + 1) if (missed**w).mean() <= 1 - RECALL), 0)
                if walks:
                    out[n] = (m, walks * TABLES_OF_WALK)
                    break
        return out

    def _signatures(self, words: np.ndarray, starts: np.ndarray, n: int, end: np.ndarray | None = None, walk: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Of each table, or each of one walk, a key of each window."""
        mask, tables = self.plan[n]
        for w in range(tables // TABLES_OF_WALK) if walk is None else (walk,):
            e = embed(words, starts, n, w, end)
            rng = np.random.default_rng(1000 + w)
            for t in range(w * TABLES_OF_WALK, (w + 1) * TABLES_OF_WALK):
                sig = np.full(len(starts), K.U(t * 7919 + n))
                for j in rng.choice(STEPS * n, mask, replace=False):
                    sig = K.mix(sig * K.U(31) + e[:, j])
                yield t, sig

    def _places(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each word, the number of the pair it begins; the count of pairs where that is no item's pair."""
        h = pair_hashes(words)
        own = np.flatnonzero(_member(h, self.pairs))
        out = np.full(len(words), len(self.pairs))
        out[own] = np.searchsorted(self.pairs, h[own])
        out[first[1:][first[1:] > first[:-1]] - 1] = len(self.pairs)
        return out

    def _windows(self, flags: np.ndarray, end: np.ndarray, least: int, most: int) -> np.ndarray:
        """Positions from which ``most`` words hold at least ``least`` flagged pairs."""
        hits = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=hits[1:])
        return np.flatnonzero(hits[np.minimum(np.arange(len(flags)) + most, end) - 1] - hits[:-1] >= least)

    def suspects(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Documents that the filter of all items together leaves."""
        if len(words) < 2 or not self.words:
            return np.zeros(0, np.int64)
        # the bound isn't monotone in n: 15 words need 8 pairs, 16 words 7
        least, most = min(n - 1 - 2 * (n // 4) for n in self.sizes), max(self.sizes)
        end = np.repeat(first[1:], np.diff(first))
        at = self._windows(self._places(words, first) < len(self.pairs), end, least, most + most // 4)
        return np.unique(np.searchsorted(first, at, "right") - 1)

    def short_leaks(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, short item, start, words) of exact copies, the earliest in each document."""
        for n, (keys, own) in self.short.items():
            h = run_hashes(words, n)
            seen: set[tuple[int, int]] = set()
            for p in np.flatnonzero(_member(h, keys)).tolist():
                d = int(np.searchsorted(first, p, "right")) - 1
                if p + n > first[d + 1]:
                    continue
                for j in range(int(np.searchsorted(keys, h[p])), int(np.searchsorted(keys, h[p], "right"))):
                    k = int(own[j])
                    if (d, k) not in seen and np.array_equal(self.short_words[k], words[p : p + n]):
                        seen.add((d, k))
                        yield d, k, p - int(first[d]), n

    def leaks(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, words) for the documents words[first[i] : first[i + 1]]."""
        if len(words) < 2 or not self.words:
            return
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[tuple[int, int, int], bool] = {}
        own_sets = self.own_pairs

        def searched(d: int, item: int, lo: int, hi: int) -> bool:
            """Is the item leaked by a run that begins from lo to hi?  Runs have up to n // 4 words more."""
            w = self.words[item]
            n, k = len(w), len(w) // 4
            a, b = max(int(first[d]), lo), min(int(first[d + 1]), hi + n + k)
            if len(own_sets[item] - set(pair_hashes(words[a:b]).tolist())) > 2 * k:
                return False
            dist, s, e = best_run(w, words[a:b])
            if dist > k:
                return False
            here = (dist, a + s - int(first[d]), e - s)
            best[d, item] = min(best.get((d, item), here), here)
            return True

        def verify(d: int, item: int, p: int) -> bool:
            """Is the item leaked by a run that begins within n // 4 words of p?  Positions are taken in blocks of
            that many; around a leak, all runs that begin within n // 2 are searched for the nearest."""
            n = len(self.words[item])
            k = n // 4
            block = (p - int(first[d])) // k
            found = tried.get((d, item, block))
            if found is None:
                at = int(first[d]) + block * k
                found = tried[d, item, block] = searched(d, item, at - k, at + 2 * k)
                if found:
                    searched(d, item, p - n // 2 - k, p + n // 2 + k)
                    for x in range(-(-(p - n // 2 - int(first[d])) // k), (p + n // 2 - int(first[d])) // k):
                        tried[d, item, x] = True
            return found

        places, end = self._places(words, first), np.repeat(first[1:], np.diff(first))
        for n, (pairs, keys, items) in self.sizes.items():
            k = n // 4
            every = self._windows(pairs[places], end, n - 1 - 2 * k, n + k)
            having = self.having.get(n)
            if having is not None:  # no tables reach the recall: items with enough of the window's pairs
                for p, d in zip(every.tolist(), (np.searchsorted(first, every, "right") - 1).tolist(), strict=True):
                    shared: dict[int, int] = {}
                    for x in set(pair_hashes(words[p : min(p + n + k, int(first[d + 1]))]).tolist()):
                        for item in having.get(x, ()):
                            shared[item] = shared.get(item, 0) + 1
                    for item, c in shared.items():
                        if c >= len(own_sets[item]) - 2 * k:
                            verify(d, item, p)
                continue
            for part in range(0, len(every), 1 << 14):
                s = every[part : part + (1 << 14)]
                for walk in range(self.plan[n][1] // TABLES_OF_WALK):
                    if not len(s):
                        break
                    doc = np.searchsorted(first, s, "right") - 1
                    done = np.zeros(len(s), bool)
                    for _, sig in self._signatures(words, s, n, first[doc + 1], walk):
                        a = np.searchsorted(keys, sig)
                        for h in np.flatnonzero((keys[np.minimum(a, len(keys) - 1)] == sig) & ~done):
                            d, p, j = int(doc[h]), int(s[h]), int(a[h])
                            while j < len(keys) and keys[j] == sig[h]:
                                if verify(d, int(items[j]), p):
                                    for other in self.alike[int(items[j])]:
                                        verify(d, other, p)
                                    done |= (doc == d) & (np.abs(s - p) <= n // 2)
                                j += 1
                    s = s[~done]
        for (d, item), found in sorted(best.items()):
            yield d, item, *found


def _member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    hit = np.zeros(1 << 18, bool)
    hit[(sorted_ & K.U((1 << 18) - 1)).astype(np.int64)] = True
    out = hit[(values & K.U((1 << 18) - 1)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    out[maybe] = sorted_[np.minimum(np.searchsorted(sorted_, values[maybe]), len(sorted_) - 1)] == values[maybe]
    return out


def _search(index):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            first = np.append(0, np.cumsum([len(x) for x in held]))
            rows = list(ix.leaks(np.concatenate(held), first)) if held else []
            if rows:
                d, item, dist, start, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[x] for x in d], pa.int64()), pa.array([ix.ids[k] for k in item], pa.int64()), pa.array(dist, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())],
                    names=["doc_id", "item_id", "distance", "start_word", "n_words"],
                )

        for batch in batches:
            for lo, _, raw, offs in K.pieces(batch.column(1)):
                w = K.Words(raw, offs, K.LOWER, K.NOT_ALNUM)
                h = w.hashes
                short = list(ix.short_leaks(h, w.first))
                if short:
                    d, item, start, n = zip(*short, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[lo + x].as_py() for x in d], pa.int64()), pa.array([ix.short_ids[k] for k in item], pa.int64()), pa.array([0] * len(d), pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int32())],
                        names=["doc_id", "item_id", "distance", "start_word", "n_words"],
                    )
                for d in ix.suspects(h, w.first).tolist():
                    names.append(batch.column(0)[lo + d].as_py())
                    held.append(h[w.first[d] : w.first[d + 1]].copy())
                    size += len(held[-1])
                if size >= HELD_WORDS:
                    yield from found()
                    names, held, size = [], [], 0
        yield from found()

    return f


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start_word, n_words of each leaking pair."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.lit(0)).first()[0]
    passes = max(1, -(-size // (6 * ITEM_WORDS)))
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").toArrow()
        words = item_words(part.column("text"))
        index = spark.sparkContext.broadcast(Index(part.column("item_id").to_pylist(), words))
        found = docs.mapInArrow(_search(index), _LEAKS)
        out = found if out is None else out.union(found)
    best = F.min(F.struct("distance", "start_word", "n_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.distance", "b.start_word", "b.n_words")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item; of rows without a doc_id those with a leaking text go."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    key = F.xxhash64(F.col("doc_id").isNull(), own, F.when(F.col("doc_id").isNull(), F.col("text").cast("string")))
    found = leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, key == found["_leak"], "left_anti")
