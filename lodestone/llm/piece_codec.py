"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A merge-type encoding joins, again and again, the two neighbours whose union has the best score
(the leftmost of equals).  Its result is the one sequence of pieces in which every piece encodes to
itself and every two neighbours are compatible: encoded together they stay the two.  So a text is
encoded from left to right.  An Aho-Corasick automaton gives the pieces that start at each position;
the longest that is compatible with its predecessor is taken, and a position from which nothing led
on is marked in a bitfield of failed positions and never entered again.  Compatibility is found by
re-merging both pieces in step and watching whether a union across their border ever comes first;
answers are kept in a bounded cache.

No piece spans two characters that are neighbours in no piece, so a text is cut there without loss:
a block of texts is cut by one lookup a character, and every different segment is encoded once a
worker (a bounded cache).  Characters without a piece become byte pieces.  Texts longer than
``BLOCK`` characters are encoded block by block, what follows the last cut being carried over, so
memory is bounded by the block, its ids, and one text.

The dummy space before a text, spaces written as U+2581, no other normalisation, and byte pieces are
what such models have; a model of another kind raises ValueError on the driver.

Cases: null and empty texts have no ids and decode to the empty text.  A text's own U+2581 is a space.
Every row is encoded for itself, also rows that repeat a doc_id or have none; an empty table gives no
rows; other columns are ignored.  Ids that make no valid UTF-8 decode with U+FFFD as the library does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .stage import table

SPACE = "▁"
#: Characters encoded at a time, segments and pairs of pieces that a worker remembers.
BLOCK = 1 << 20
SEGMENTS = 1 << 19
SEGMENT_CHARS = 64
PAIRS = 1 << 18
#: Bits of the table of neighbouring characters; a clash only leaves a segment uncut.
NEIGHBOURS = 22
_IDS = "doc_id long, ids array<int>"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

Vocabulary = tuple[list[str], list[float], list[bool], int]


def vocabulary(path: str) -> Vocabulary:
    """Pieces, scores, which are ordinary, and the id of byte 0, of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    zero = sp.piece_to_id("<0x00>")
    probe = "  a  \t½Ａ \n"
    if not sp.is_byte(zero) or any(sp.id_to_piece(zero + i) != f"<0x{i:02X}>" for i in range(256)):
        raise ValueError("a model with byte pieces is needed")
    if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("a model that normalises only spaces is needed")
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    coder = Codec(([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], plain, zero))
    sample = "Merges of a  unigram model, or of words 12345, go other ways: \U0001f600 水物."
    if coder.encode([sample])[0].tolist() != sp.encode(sample):
        raise ValueError("a merge-type model is needed")
    return coder.vocabulary


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.pieces, scores, plain, self.zero = vocabulary
        self.id = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.compatible = lru_cache(PAIRS)(self._compatible)
        self.history = lru_cache(len(self.pieces))(self._history)
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or self.history(p) is not None:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.joined = np.zeros(1 << NEIGHBOURS, bool)
        for p in self.id:
            c = np.array([ord(x) for x in p], np.uint32)
            self.joined[_slot(c[:-1], c[1:])] = True
        self.characters = {p for p in self.id if len(p) == 1}
        self.remembered: dict[str, bytes] = {}
        surface = [self._surface(i, p, plain[i]) for i, p in enumerate(self.pieces)]
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.ends = np.cumsum([0, *map(len, surface)])
        self.decimals = np.frombuffer(b"".join(b"%d," % i for i in range(len(self.pieces))), np.uint8)
        self.decimal_ends = np.cumsum([0, *(len(b"%d," % i) for i in range(len(self.pieces)))])

    def _surface(self, i: int, piece: str, plain: bool) -> bytes:
        if self.zero <= i < self.zero + 256:
            return bytes([i - self.zero])
        return piece.replace(SPACE, " ").encode() if plain else b" \xe2\x81\x87 " if piece == "<unk>" else b""

    # -- merging

    def _history(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, in order: score, and the first and last
        symbols after each.  None where the characters become something else."""
        symbols, out = list(piece), []
        while len(symbols) > 1:
            found = [(-self.score[u], i) for i, u in enumerate(map("".join, zip(symbols, symbols[1:]))) if u in self.score]
            if not found:
                return None
            cost, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            out.append((-cost, symbols[0], symbols[-1]))
        return out

    def _compatible(self, left: str, right: str) -> bool:
        """Whether both pieces, encoded together, stay the two.  Their merges run in step, the better
        score first and the left one of equals; a union across the border that is better ends it."""
        a, b = self.history(left) or [], self.history(right) or []
        i = j = 0
        end, start = left[-1], right[0]
        score = self.score
        while True:
            across = score.get(end + start)
            x = a[i][0] if i < len(a) else None
            y = b[j][0] if j < len(b) else None
            if across is not None and (x is None or across > x) and (y is None or across >= y):
                return False
            if x is not None and (y is None or x >= y):
                end = a[i][2]
                i += 1
            elif y is not None:
                start = b[j][1]
                j += 1
            else:
                return True

    # -- encoding

    def _known(self, text: str) -> list[str]:
        """The pieces of a text whose characters all have one."""
        n = len(text)
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(text):  # shorter before longer
            starting[end - size + 1].append(size)
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        tried: list[int] = []  # how many of the pieces that start at each taken position are left
        compatible = self.compatible
        at, left = 0, len(starting[0])
        while at < n:
            last = out[-1] if out else None
            while left:
                left -= 1
                to = at + starting[at][left]
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                piece = text[at:to]
                if last is None or compatible(last, piece):
                    out.append(piece)
                    tried.append(left)
                    at = to
                    left = len(starting[at]) if at < n else 0
                    break
            else:  # nothing leads on from here
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                left = tried.pop()
        return out

    def _segment(self, text: str) -> bytes:
        """Ids of a segment as little-endian 32-bit integers."""
        if self.characters.issuperset(text):
            return np.array([self.id[p] for p in self._known(text)], "<u4").tobytes()
        ids, run = [], 0
        for i, c in enumerate(text):
            if c not in self.characters:
                ids += [self.id[p] for p in self._known(text[run:i])] if i > run else []
                ids += [self.zero + x for x in c.encode()]
                run = i + 1
        ids += [self.id[p] for p in self._known(text[run:])] if run < len(text) else []
        return np.array(ids, "<u4").tobytes()

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Ids of segments, each different one encoded once while it is remembered."""
        out = list(map(self.remembered.get, segments))
        for i, x in enumerate(out):
            if x is None:
                s = segments[i]
                x = self.remembered.get(s)
                if x is None:
                    x = self._segment(s)
                    if len(s) <= SEGMENT_CHARS:
                        if len(self.remembered) >= SEGMENTS:
                            self.remembered.clear()
                        self.remembered[s] = x
                out[i] = x
        return out

    def _cuts(self, text: str) -> np.ndarray:
        """Positions inside the text where no piece goes across."""
        c = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return np.flatnonzero(~self.joined[_slot(c[:-1], c[1:])]) + 1

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are whole, or end at a cut."""
        flat = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        inside = np.zeros(len(flat) + 1, bool)
        inside[0] = True
        inside[ends] = True
        if flat:
            inside[self._cuts(flat)] = True
        cuts = np.flatnonzero(inside)
        bounds = cuts.tolist()
        found = self._segments([flat[a:b] for a, b in zip(bounds, bounds[1:])])
        size = np.cumsum([0, *(len(x) // 4 for x in found)])
        ids = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
        at = size[np.searchsorted(cuts, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _long(self, text: str) -> np.ndarray:
        out, carry = [], ""
        for lo in range(0, len(text), BLOCK):
            part = carry + text[lo : lo + BLOCK]
            if lo + BLOCK < len(text):
                cuts = self._cuts(part)
                at = int(cuts[-1]) if len(cuts) else 0
                part, carry = part[:at], part[at:]
            if part:
                out += self._block([part])
        return np.concatenate(out)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for t in texts:
            t = SPACE + t.replace(" ", SPACE) if t else ""
            if size + len(t) > BLOCK and held:
                out += self._block(held)
                held, size = [], 0
            if len(t) > BLOCK:
                out.append(self._long(t))
            else:
                held.append(t)
                size += len(t)
        return out + self._block(held) if held else out

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the dummy space goes, bytes that aren't UTF-8 become U+FFFD one by one."""
        raw = _gather(self.bytes, self.ends, ids)
        if len(ids) and self.pieces[ids[0]].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)

    def digest(self, ids: np.ndarray) -> str:
        """sha256 of the decimal ids, joined by commas."""
        return hashlib.sha256(_gather(self.decimals, self.decimal_ends, ids)[:-1]).hexdigest()


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - NEIGHBOURS)


def _gather(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> bytes:
    """The byte strings of a list of indexes, one after another."""
    size = ends[which + 1] - ends[which]
    at = np.cumsum(size)
    total = int(at[-1]) if len(at) else 0
    return flat[np.arange(total) + np.repeat(ends[which] - at + size, size)].tobytes()


def _lenient(raw: bytes) -> str:
    """Valid characters, and U+FFFD for every byte that belongs to none."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a broadcast vocabulary, one a worker."""
    key = shared.value[1]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value[0])
    return _codecs[key]


def _encode(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            lo, n = 0, batch.num_rows
            sizes = pc.utf8_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while lo < n:  # rows of about a block
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
                ids = codec.encode(batch.column("text").slice(lo, hi - lo).to_pylist())
                at = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "ids"])
                lo = hi

    return f


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each row (none where they are null)."""
    for x in batch.column("ids"):
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)


def _decode(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(x) for x in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return f


def _digests(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            n, a, b = [], [], []
            for ids in _rows(batch):
                n.append(len(ids))
                a.append(codec.digest(ids))
                b.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return f


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def shared_vocabulary(spark: SparkSession, model_path: str | None = None):
    """The vocabulary of a model file, sent to all executors (its size is the model's)."""
    found = vocabulary(model_path or default_model())
    return spark.sparkContext.broadcast((found, hashlib.sha256(repr(found).encode()).hexdigest()))


def encoded(docs: DataFrame, shared=None) -> DataFrame:
    """doc_id and ids of docs(doc_id, text)."""
    shared = shared or shared_vocabulary(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_encode(shared), _IDS)


def decoded(rows: DataFrame, shared=None) -> DataFrame:
    """doc_id and text of rows(doc_id, ids)."""
    shared = shared or shared_vocabulary(rows.sparkSession)
    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(ids AS ARRAY<INT>) AS ids").mapInArrow(_decode(shared), "doc_id long, text string")


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = shared_vocabulary(spark)
    return encoded(table(spark, sf_dir, "documents"), shared).mapInArrow(_digests(shared), _DIGEST)
