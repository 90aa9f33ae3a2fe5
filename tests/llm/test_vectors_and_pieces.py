"""Centroid clusters, vector codes and the piece codec, against plain loops and the library."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import sentencepiece

from lodestone.llm import adaptive_clusters as A
from lodestone.llm import piece_codec as P
from lodestone.llm import vector_codes as V

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance string, n int, code string"


def rows_of(rng, n, dims, grid):
    """Vectors on a coarse grid: many ties and repeated rows."""
    return [(i, [float(x) / grid for x in rng.integers(-grid, grid + 1, dims)], int(rng.integers(3)) if i % 7 else None, 1, "x", 2, "y") for i in range(n)]


def bad_rows(dims):
    return [(9001, None, 1, 1, "x", 2, "y"), (9002, [], 1, 1, "x", 2, "y"), (9003, [1.0] * (dims - 1) + [None], 1, 1, "x", 2, "y"), (9004, [float("nan")] * dims, 1, 1, "x", 2, "y"), (9005, [float("inf")] + [0.0] * (dims - 1), 1, 1, "x", 2, "y"), (9006, [1.0] * (dims - 1), 1, 1, "x", 2, "y")]


def plain_clusters(rows, k, rounds, scale, seed=1):
    x = {i: np.array([int(np.floor(scale * np.float64(np.float32(v)))) for v in e]) for i, e in rows}
    order = sorted(x, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    c = [x[i] for i in order[:k]]
    for n in range(rounds + 1):
        found = {i: min((int(((v - z) ** 2).sum()), j) for j, z in enumerate(c)) for i, v in x.items()}
        if n < rounds:
            for j in range(len(c)):
                own = [x[i] for i in x if found[i][1] == j]
                if own:
                    c[j] = sum(own) // len(own)
    return {(i, j, d) for i, (d, j) in found.items()}, [z.tolist() for z in c]


@pytest.mark.parametrize(("n", "dims", "grid", "k", "rounds"), [(300, 4, 2, 16, 6), (300, 8, 5, 40, 5), (5, 3, 2, 16, 3), (1, 3, 1, 16, 3), (60, 64, 40, 2, 3), (80, 2, 1, 9, 4)])
def test_clusters_equal_a_plain_loop(spark, n, dims, grid, k, rounds):
    rows = rows_of(np.random.default_rng(n + k), n, dims, grid)
    df = spark.createDataFrame(rows + bad_rows(dims), VECTORS).repartition(3)
    found, info = A.clusters(df, k, rounds, dims, 7)
    want, centroids = plain_clusters([(r[0], r[1]) for r in rows], k, rounds, 7)
    assert {tuple(r) for r in found.collect()} == want
    assert [x["centroid"] for x in info] == centroids
    assert sum(x["n"] for x in info) == n and sum(x["inertia"] for x in info) == sum(d for _, _, d in want)


def test_bounds_certify_and_stay_exact():
    """Bounds spare most vectors, shrink, and no vector is settled wrongly."""
    rng = np.random.default_rng(4)
    centers = rng.integers(-200, 200, (24, 12))
    x = centers[rng.integers(24, size=4000)] + rng.integers(-25, 26, (4000, 12))
    c = x[:24].copy()
    state = A.Bounds.empty(len(x), 6)
    state.rescan(np.arange(len(x)), x, c)
    needs = []
    for _ in range(8):
        count = np.bincount(state.cluster, minlength=24)
        sums = np.zeros_like(c)
        np.add.at(sums, state.cluster, x)
        new = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], c)
        state.moved(A.up(((new - c) ** 2).sum(1)))
        c = new
        needs.append(state.settle(x, c))
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (state.cluster == d2.argmin(1)).all()
        exact = np.sqrt(d2.astype(float))
        assert (state.upper >= exact[np.arange(len(x)), state.cluster]).all()
        assert (state.lower <= np.take_along_axis(exact, state.near.astype(int), 1)).all()
        others = exact.copy()
        np.put_along_axis(others, np.concatenate([state.near, state.cluster[:, None]], 1).astype(int), np.inf, 1)
        assert (state.rest <= others.min(1)).all()
        state.cut(max(3, min(state.near.shape[1], needs[-1])))
    assert needs[-1] < 6


def test_clusters_of_nothing_and_of_too_large_components(spark):
    assert A.clusters(spark.createDataFrame([], VECTORS), 4, 2, 3)[0].count() == 0
    assert A.clusters(spark.createDataFrame(bad_rows(3), VECTORS), 4, 2, 5)[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        A.clusters(spark.createDataFrame([(1, [1e30, 0.0], 1, 1, "x", 2, "y")], VECTORS), 4, 2, 2)


def test_rows_without_a_vec_id_are_clustered(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [5.0, 5.0]), (3, [4.0, 5.0])]
    found, info = A.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 2, 2, 1)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [(3, 1, 0), (3, 1, 1), (None, 0, 0), (None, 0, 0)]
    assert [x["centroid"] for x in info] == [[1, 2], [4, 5]]


def plain_codes(rows, parts, entries, rounds, scale):
    rows = sorted(rows, key=lambda r: r[0])
    x = np.array([[int(np.floor(scale * np.float64(np.float32(v)))) for v in r[1]] for r in rows]).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for n in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        near = [y.argmin(1) for y in d]
        if n < rounds:
            for p in range(parts):
                for e in set(near[p].tolist()):
                    own = x[near[p] == e, p]
                    books[p][e] = own.sum(0) // len(own)
    return {(r[0], "".join(f"{near[p][i]:02x}" for p in range(parts)), int(sum(d[p][i, near[p][i]] for p in range(parts)))) for i, r in enumerate(rows)}, books


@pytest.mark.parametrize(("n", "dims", "grid", "entries", "leaf"), [(400, 8, 3, 32, 4), (300, 8, 20, 256, 32), (150, 4, 1, 16, 1), (3, 8, 2, 256, 32), (1, 4, 1, 8, 32), (500, 64, 300, 40, 8)])
def test_codes_equal_a_plain_loop(spark, monkeypatch, n, dims, grid, entries, leaf):
    rows = rows_of(np.random.default_rng(n), n, dims, grid)
    x = np.array([[int(np.floor(11 * np.float64(np.float32(v)))) for v in r[1]] for r in rows])
    for small in (leaf, 1):  # trees of any depth
        monkeypatch.setattr(V, "LEAF", small)
        tree = V.Tree.build(x[:, : dims // 4])
        assert sorted(tree.order.tolist()) == list(range(n))
        near = ((tree.points[:, None] - tree.points[:entries][None]) ** 2).sum(2).argmin(1)
        assert (tree.codes(tree.points[:entries]) == near).all()
        count, sums = np.zeros(min(n, entries), np.int64), np.zeros((min(n, entries), dims // 4), np.int64)
        tree.totals(tree.points[:entries], count, sums)
        assert (count == np.bincount(near, minlength=len(count))).all() and sums.sum(0).tolist() == tree.points.sum(0).tolist()
    monkeypatch.undo()
    want, books = plain_codes(rows, 4, entries, 4, 11)
    df = spark.createDataFrame(rows + bad_rows(dims), VECTORS).repartition(3)
    found, got = V.codes(df, 4, entries, 4, 11)
    out = V.with_label_error(found).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in out} == want and len(out) == n
    assert all((got[p] == books[p]).all() for p in range(4))
    error = {i: e for i, _, e in want}
    label = {r[0]: r[2] for r in rows}
    assert all(r["label_error"] == sum(e for i, e in error.items() if label[i] == label[r["vec_id"]]) for r in out)
    first = V.decoded(found, got, 11).where("vec_id = 0").first()["vector"]
    code = next(c for i, c, _ in want if i == 0)
    assert first == [float(v) / 11 for p in range(4) for v in books[p][int(code[2 * p : 2 * p + 2], 16)]]


def test_whole_subtrees_are_settled_at_once():
    """With points in far clusters, boxes settle nearly all points above the leaves."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-10000, 10000, (64, 16))
    points = centers[rng.integers(64, size=8000)] + rng.integers(-20, 21, (8000, 16))
    tree, whole, single = V.Tree.build(points), [], []
    tree.assign(centers, lambda e, level, node: whole.append(np.diff(tree.ends(8000, level))[node].sum()), lambda e, point: single.append(len(point)))
    assert sum(whole) + sum(single) == 8000 and sum(whole) > 4000


def test_many_labels_and_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(V, "LABELS", 3)
    monkeypatch.setattr(V, "FREQUENT", 10)
    found = spark.createDataFrame([(i, None if i % 2 else i % 40, "00", i) for i in range(200)], "vec_id long, label long, code string, error long")
    rows = V.with_label_error(found).collect()
    key = {i: None if i % 2 else i % 40 for i in range(200)}
    assert len(rows) == 200 and all(r["label_error"] == sum(j for j in range(200) if key[j] == key[r["vec_id"]]) for r in rows)


def test_codes_of_nothing_and_other_lengths(spark):
    assert V.codes(spark.createDataFrame([], VECTORS))[0].count() == 0
    rows = [(1, [1.0] * 3, 1), (2, [0.5] * 8, 1), (3, [0.25] * 4, 1), (4, [0.75] * 8, None), (None, [0.5] * 8, None), (2, [0.125] * 8, 2)]
    found, books = V.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(2, 1, "01010101", 0), (2, 2, "00000000", 0), (4, None, "02020202", 0), (None, None, "01010101", 0)], key=repr)
    assert books.shape == (4, 4, 2)


@pytest.mark.parametrize(("query", "sql"), [(A.op11_centroid_clusters, A.SQL), (V.op12_vector_codes, V.SQL)])
def test_vectors_equal_sql(spark, query, sql):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got, want = query(spark, d), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.vocabulary(P.default_model()))


ALPHABET = ["a", "e", "th", "in", " ", "  ", "\n", "1", "7", "▁", "é", "水", "ß", "\U0001f600", "\x00", "\t", ".", ",", "'s", "ing", "un", "▁▁", "<s>", "<0x41>", "of", "́", "ж", "ст", "가", "ﬁ", "　", "�"]


def texts(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        x = "".join(rng.choice(ALPHABET if i % 3 else "aeinorst lhdcu▁ ") for _ in range(rng.randint(0, 60)))
        yield " " * rng.randint(0, 40) + x + " " * rng.randint(0, 40) if i % 7 == 0 else x


def test_pieces_are_the_librarys(codec, library):
    for x in [*texts(4000, 1), "", "a", " ", "a" * 3000, "水" * 1000, " " * 1000, "e" * 777 + "\n" * 50]:
        ids = codec.encode([x])[0]
        assert ids.tolist() == library.encode(x), x
        assert codec.decode(ids) == library.decode(ids.tolist()), x


def test_pieces_in_blocks_and_with_a_small_cache(codec, library, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 37)
    monkeypatch.setattr(P, "SEGMENTS", 5)
    some = list(texts(600, 2))
    assert [x.tolist() for x in codec.encode([*some, None])] == [*map(library.encode, some), []]


def test_any_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(5)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_neighbours_are_compatible_as_plain_merging_says(codec):
    """Compatibility against joining both pieces' characters anew."""

    def merged(text):
        s = list(text)
        while True:
            found = [(-codec.score[u], i) for i, u in enumerate(map("".join, zip(s, s[1:]))) if u in codec.score]
            if not found:
                return s
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    rng = random.Random(8)
    known = [p for p in codec.id if codec.history(p) is not None]
    short = [p for p in known if len(p) < 4 or set(p) == {P.SPACE}]
    for _ in range(6000):
        a, b = rng.choice(short), rng.choice(short if rng.random() < 0.7 else known)
        assert codec.compatible(a, b) == (merged(a + b) == [a, b])


def test_documents_of_every_kind(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (3, "same", "d"), (3, "same", "d"), (4, "x" * 200000 + " end", "e"), (5, "▁ mark", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    shared = P.shared_vocabulary(spark)
    got = P.encoded(docs, shared)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got.collect()), key=repr) == sorted(((d, library.encode(t or "")) for d, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in P.decoded(got, shared).collect()), key=repr) == sorted(((d, (t or "").replace("▁", " ")) for d, t, _ in rows), key=repr)
    assert P.encoded(docs.limit(0), shared).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in P.decoded(nulls, shared).collect()] == [(1, "")]


def test_op13_over_a_table(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in P.op13_piece_codec(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "")
        want = (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert got[r["doc_id"]] == want


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(b"")
    with pytest.raises(Exception):
        P.vocabulary(str(tmp_path / "m.model"))
