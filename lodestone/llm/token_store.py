"""Token ids in wavelet-matrix shards.

Documents are dealt by ranges of doc_id (sampled bounds), sorted, and encoded by the
tokenizers library; each run of up to ``SHARD_DOCS`` documents and ``SHARD_TOKENS`` ids
becomes one self-contained compressed shard, a row of a Parquet table written by Spark,
so any store will do.
A shard holds, for its own sorted alphabet of ids, the bit planes of a wavelet matrix
with rank directories; ``Shard`` answers access, count and locate (rank and select)
from those bytes alone.  Reading back decodes whole shards by undoing the stable
partitions plane by plane.

Encoding keeps a bounded cache of pieces.  A single space or newline with other
characters than white space on both sides always starts a new pre-token of byte-level
BPE, so a text is cut there and each distinct piece of a batch is encoded by the library
once; the ids are the library's for the whole text (tested).

Cases: null and empty texts are the end id alone.  Documents sort by doc_id, nulls
first; rows that repeat a doc_id follow each other by a hash of the text, then the text,
each with its own ids.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .stage import new_path, table

END_ID = 2
#: A shard has at most so many documents, and so many ids unless one document alone has more.
SHARD_DOCS = 2048
SHARD_TOKENS = 1 << 20
#: Documents of one range of doc_id.
RANGE_DOCS = 4096
#: Bytes of text encoded at a time.
ENCODED_BYTES = 2 << 20
#: Slots of a worker's cache (88 MB when all are used), each for a piece of so many bytes and ids.
CACHE_SLOTS = 1 << 21
CACHE_BYTES = 24
CACHE_IDS = 8
RANK_STEP = 512
_MAGIC = b"WVM1"
_SHARDS = "part int, start long, n_tokens long, shard binary"
_DIGEST = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"

_STOPS = ",."
#: Texts with two white-space characters in a row, or one at an end, are cut by the library alone.
_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_GLUED = f"{_SPACES}{_SPACES}|\\A{_SPACES}|{_SPACES}\\z"
_WHITE = re.compile(r"\s")


def _stop_cuts(raw: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Commas and full stops between a letter and a space, a newline or the text's end: pre-tokens of
    their own.  Letters are looked for in ASCII and in the second bytes of U+00C0 to U+00FF only."""
    out = np.zeros(len(raw), bool)
    at = np.flatnonzero((raw == 44) | (raw == 46))
    at = at[at > 1]
    ends = np.zeros(len(raw) + 1, bool)
    ends[o] = True
    after = raw[np.minimum(at + 1, len(raw) - 1)]
    before, second = raw[at - 1], raw[at - 2]
    letter = ((before | 32) >= 97) & ((before | 32) <= 122) | (second == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80)
    out[at[letter & ((after == 32) | (after == 10) | ends[at + 1]) & ~ends[at]]] = True
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit arrays (all ids are below 65,536)."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        vocabulary = self.tok.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.starts = np.zeros(1 << 16, bool)
        self.starts[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True  # a space in byte-level BPE
        self.newline = self._ids(["\n"])[0]
        self.stops = dict(zip(_STOPS, self._ids(list(_STOPS)), strict=True))
        #: A cache of one piece a slot: bytes of pieces with the delimiter before them, and their ids.
        self.keys = np.zeros((CACHE_SLOTS, CACHE_BYTES // 8), np.uint64)
        self.key_size = np.zeros(CACHE_SLOTS, np.uint8)
        self.values = np.zeros((CACHE_SLOTS, CACHE_IDS), "<u2")
        self.value_size = np.zeros(CACHE_SLOTS, np.uint8)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space.  Those without other white space are encoded as one
        text, where each starts with the one id of its that begins with a space."""
        plain = [i for i, x in enumerate(pieces) if len(x) > 1 and not _WHITE.search(x, 1)]
        out: list[bytes] = [b""] * len(pieces)
        ids = np.array(self.tok.encode_batch_fast(["".join([pieces[i] for i in plain])], add_special_tokens=False)[0].ids if plain else [], "<u2")
        starts = np.flatnonzero(self.starts[ids])
        if len(starts) != len(plain):
            plain, starts = [], starts[:0]
        data, bounds = ids.tobytes(), [*(2 * starts).tolist(), 2 * len(ids)]
        for i, lo, hi in zip(plain, bounds, bounds[1:]):
            out[i] = data[lo:hi]
        rest = [i for i, x in enumerate(out) if not x]
        for i, x in zip(rest, self._ids([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces not yet known.  A comma or full stop after a letter is a pre-token of its
        own at the end of a piece, and so is the newline before one."""
        stopped = {x: x[:-1] for x in pieces if x[-1:] in self.stops and x[-2:-1].isalpha()}
        lined = {x for x in pieces if x[:1] == "\n" and len(x) > 1 and not x[1].isspace()}
        whole = {stopped.get(x, x) for x in pieces}
        spaced = [x for x in whole if x[:1] == " "]
        bare = list({x[1:] if x[:1] == "\n" and len(x) > 1 and not x[1].isspace() else x for x in whole if x[:1] != " "})
        found: dict[str, bytes] = {"": b""}
        for part, f in ((spaced, self._joined), (bare, self._ids)):
            for lo in range(0, len(part), 4096):
                found.update(zip(part[lo : lo + 4096], f(part[lo : lo + 4096]), strict=True))
        out = []
        for x in pieces:
            body = stopped.get(x, x)
            ids = self.newline + found[body[1:]] if x in lined else found[body]
            out.append(ids + self.stops[x[-1]] if x in stopped else ids)
        return out

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and where each piece's begin and how many they are."""
        raw, o = K.buffers(pieces)
        n = np.diff(o)
        byte = np.arange(CACHE_BYTES)
        key = np.where(byte < n[:, None], raw[np.minimum(o[:-1, None] + byte, max(len(raw) - 1, 0))], 0).astype(np.uint8).view(np.uint64) if len(raw) else np.zeros((len(n), CACHE_BYTES // 8), np.uint64)
        h = n.astype(np.uint64)
        for k in range(key.shape[1]):
            h = K.mix(h ^ key[:, k])
        slot = (h & K.U(CACHE_SLOTS - 1)).astype(np.int64)
        hit = (n <= CACHE_BYTES) & (self.key_size[slot] == n) & (self.keys[slot] == key).all(1)
        hits, lack = np.flatnonzero(hit), np.flatnonzero(~hit)
        learned = self._learn(pieces.take(pa.array(lack)).cast(pa.string()).to_pylist())
        size = np.zeros(len(n), np.int64)
        size[hits] = self.value_size[slot[hits]]
        size[lack] = np.array([len(x) // 2 for x in learned], np.int64)
        flat = self.values[slot[hits]][np.arange(CACHE_IDS) < size[hits][:, None]]
        first = np.zeros(len(n), np.int64)
        first[hits] = np.cumsum(size[hits]) - size[hits]
        first[lack] = len(flat) + np.cumsum(size[lack]) - size[lack]
        new = np.frombuffer(b"".join(learned), "<u2")
        keep = lack[(n[lack] <= CACHE_BYTES) & (size[lack] <= CACHE_IDS)]
        to, at = slot[keep], np.minimum(first[keep][:, None] - len(flat) + np.arange(CACHE_IDS), max(len(new) - 1, 0))
        _, last = np.unique(to[::-1], return_index=True)  # of several pieces for a slot, the same one everywhere
        last = len(to) - 1 - last
        self.keys[to[last]], self.key_size[to[last]] = key[keep[last]], n[keep[last]]
        self.values[to[last]], self.value_size[to[last]] = new[at[last]], size[keep[last]]
        return np.concatenate([flat, new]), first, size

    def ids(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many are each text's; ``end`` follows each.

        Between characters other than white space, a single space begins a pre-token and a single
        newline is one, so texts are cut before each and every distinct piece is encoded once.
        """
        column = column.cast(pa.string()).fill_null("")
        glued = pc.match_substring_regex(column, _GLUED).to_numpy(zero_copy_only=False)
        raw, o = K.buffers(column)
        raw, o = raw[o[0] : o[-1]], o - o[0]
        cut = np.append((raw == 32) | (raw == 10) | _stop_cuts(raw, o), False)
        for i in np.flatnonzero(glued):
            cut[o[i] : o[i + 1]] = False
        cut[o[:-1][np.diff(o) > 0]] = True
        at = np.flatnonzero(cut)
        n_pieces = np.diff(np.searchsorted(at, o))
        data = pa.py_buffer(raw)
        distinct = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), data]).dictionary_encode()
        store, first, size = self._known(distinct.dictionary)
        store, first, size = np.append(store, np.uint16(end or 0)), np.append(first, len(store)), np.append(size, int(end is not None))
        # each text's pieces, then the end id as one more piece
        codes = np.full(len(at) + len(column), len(first) - 1, np.int64)
        place = np.arange(len(at)) + np.repeat(np.arange(len(column)), n_pieces)
        codes[place] = distinct.indices.to_numpy()
        long = size[codes]
        stop = np.cumsum(long)
        out = store[np.repeat(first[codes] - (stop - long), long) + np.arange(stop[-1] if len(stop) else 0)]
        last = np.cumsum(n_pieces + 1) - 1
        return out, np.diff(stop[last], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, n = self.ids(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


_encoders: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    key = hash(model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of a shard."""
    present = np.flatnonzero(np.bincount(ids, minlength=1)).astype("<u2") if len(ids) else np.zeros(0, "<u2")
    back = np.zeros(1 << 16, np.uint16)
    back[present] = np.arange(len(present))
    seq = back[ids]
    planes = max(1, int(len(present) - 1).bit_length()) if len(present) else 1
    zeros, bits, ranks = [], [], []
    for k in range(planes - 1, -1, -1):
        one = (seq & np.uint16(1 << k)) != 0
        packed = np.packbits(one, bitorder="little")
        packed = np.append(packed, np.zeros(-len(packed) % (RANK_STEP // 8), np.uint8))
        bits.append(packed)
        step = np.bitwise_count(packed.reshape(-1, RANK_STEP // 8).view(np.uint64)).sum(1, dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
        ranks.append(np.append(np.uint32(0), np.cumsum(step, dtype=np.uint32)).astype("<u4"))
        low = seq.compress(~one)
        zeros.append(len(low))
        seq = np.concatenate([low, seq.compress(one)])
    none = np.array([x is None for x in doc_ids], np.uint8)
    docs = np.array([0 if x is None else x for x in doc_ids], "<i8")
    parts = [present.tobytes(), docs.tobytes(), none.tobytes(), np.array(lengths, "<i8").tobytes(), np.array(zeros, "<i8").tobytes()]
    parts += [x.tobytes() for x in ranks] + [x.tobytes() for x in bits]
    packed_parts = [zlib.compress(x, 1) for x in parts[: len(parts) - planes]] + [x.tobytes() for x in bits]
    head = struct.pack("<4sqqii", _MAGIC, len(ids), len(docs), planes, len(packed_parts)) + struct.pack(f"<{len(packed_parts)}q", *map(len, packed_parts))
    return head + b"".join(packed_parts)


class Shard:
    """A shard's documents, and random access, counts and occurrences of its ids."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_docs, self.planes, k = struct.unpack_from("<4sqqii", data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sqqii")
        sizes = struct.unpack_from(f"<{k}q", data, at)
        at += 8 * k
        parts = []
        for i, s in enumerate(sizes):
            x = data[at : at + s]
            parts.append(x if i >= k - self.planes else zlib.decompress(x))
            at += s
        self.alphabet = np.frombuffer(parts[0], "<u2")
        none = np.frombuffer(parts[2], np.uint8)
        self.doc_ids = [None if m else int(d) for d, m in zip(np.frombuffer(parts[1], "<i8"), none, strict=True)]
        self.lengths = np.frombuffer(parts[3], "<i8")
        self.zeros = np.frombuffer(parts[4], "<i8")
        self.ranks = [np.frombuffer(x, "<u4") for x in parts[5 : 5 + self.planes]]
        self.bits = [np.frombuffer(x, np.uint8) for x in parts[5 + self.planes :]]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_STEP
        lo = block * RANK_STEP // 8
        tail = np.unpackbits(self.bits[plane][lo : lo + RANK_STEP // 8], bitorder="little")[: i - block * RANK_STEP]
        return int(self.ranks[plane][block]) + int(tail.sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this kind in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for p in range(self.planes):
            ones = self._rank1(p, i)
            bit = int(self.bits[p][i >> 3]) >> (i & 7) & 1
            symbol = symbol * 2 + bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return int(self.alphabet[symbol])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int] | None:
        s = int(np.searchsorted(self.alphabet, token))
        if s == len(self.alphabet) or self.alphabet[s] != token:
            return None
        for p in range(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            if s >> (self.planes - 1 - p) & 1:
                lo, hi = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        r = self._range(token, lo, self.n if hi is None else hi)
        return r[1] - r[0] if r else 0

    def locate(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0; -1 if there are fewer."""
        r = self._range(token, 0, self.n)
        if r is None or not 0 <= k < r[1] - r[0]:
            return -1
        s, i = int(np.searchsorted(self.alphabet, token)), r[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = s >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        seq = np.zeros(self.n, np.uint16)
        for p in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.bits[p], count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[p])
            out = np.empty(self.n, np.uint16)
            out[np.flatnonzero(~one)] = seq[:z]
            out[np.flatnonzero(one)] = seq[z:] | np.uint16(1 << (self.planes - 1 - p))
            seq = out
        return self.alphabet[seq] if self.n else seq


def _write(model):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, start = encoder(model.value), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        lengths: list[int] = []

        def shard() -> pa.RecordBatch:
            nonlocal start, held, docs, lengths
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start]), pa.array([len(ids)]), pa.array([build(ids, docs, lengths)], pa.binary())], names=["part", "start", "n_tokens", "shard"])
            start, held, docs, lengths = start + len(ids), [], [], []
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi, _, _ in K.pieces(texts, ENCODED_BYTES):
                flat, n = enc.ids(texts.slice(lo, hi - lo), END_ID)
                ends = np.cumsum(n)
                at = 0
                while at < len(n):  # as many documents as the open shard has room for, one at least
                    before = int(ends[at - 1]) if at else 0
                    room = SHARD_TOKENS - sum(lengths)
                    to = min(int(np.searchsorted(ends, before + room, "right")), at + SHARD_DOCS - len(docs))
                    if to <= at and docs:
                        yield shard()
                        continue
                    to = max(to, at + 1)
                    held.append(flat[before : int(ends[to - 1])])
                    docs += names[lo + at : lo + to]
                    lengths += n[at:to].tolist()
                    at = to
        if docs:
            yield shard()

    return f


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            s = Shard(batch.column(2)[i].as_py())
            ids = s.decode().astype("<u4")
            ends = np.cumsum(s.lengths)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, s.lengths, strict=True)]
            first = batch.column(1)[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * s.n_docs, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(first + ends - s.lengths), pa.array(s.lengths), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the shards of docs(doc_id, text) as a Parquet table at path."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(12, -(-rows.count() // RANGE_DOCS))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    sorted_.mapInArrow(_write(model), _SHARDS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    before, offsets = 0, []
    for r in shards.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    base = spark.createDataFrame(offsets, "part int, base long")
    rows = shards.select("part", "start", "shard").mapInArrow(_read, _DIGEST)
    return rows.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def store(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    path = path or new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path or default_tokenizer())
    return read(docs.sparkSession, path)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return store(docs)
