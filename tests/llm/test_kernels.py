"""Kernels and models without Spark."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontaminate, gbt, token_store, warc
from lodestone.llm import kernels as K
from lodestone.llm import quality_rules as R
from lodestone.llm.jaccard_join import answer

TEXT = st.text(alphabet="abAB \n\t,.é日>", max_size=80)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_shingle_sets_are_those_of_words(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    seen: dict = {}
    for lo, _, raw, offs in K.pieces(pa.array(texts, pa.string()), 40):
        values, ends = K.shingle_sets(raw, offs)
        for i in range(len(offs) - 1):
            got = values[ends[i] : ends[i + 1]].tolist()
            assert len(got) == len(want[lo + i])
            assert seen.setdefault(frozenset(want[lo + i]), got) == got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=5))
def test_quality_counts(texts):
    for lo, _, raw, offs in K.pieces(pa.array(texts, pa.string())):
        c = R.counts(raw, offs)
        for i in range(len(offs) - 1):
            t = texts[lo + i] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
            covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
            got = {k: int(v[i]) for k, v in c.items()}
            assert got == {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_answers_join_the_components_of_all_links():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1, 1 << 60, 80).astype(np.uint64))
    sets = []
    for _ in range(40):
        s = base[rng.random(len(base)) > rng.random() * 0.3]
        sets.append(np.unique(np.append(s, rng.integers(1, 1 << 60, rng.integers(0, 12)).astype(np.uint64))))
    comp = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
                comp[comp == comp[i]] = comp[j]
    got = np.arange(len(sets))
    for a, b in answer(sets, np.arange(len(sets))):
        got[got == got[a]] = got[b]
    assert {frozenset(np.flatnonzero(comp == c)) for c in comp} == {frozenset(np.flatnonzero(got == c)) for c in got}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300))
def test_wavelet_shard_round_trip(ids):
    x = np.array(ids, "<u2")
    s = token_store.Shard(token_store.build(x, [None, 7], [len(ids), 0]))
    assert s.decode().tolist() == ids and s.doc_ids == [None, 7]
    for t in {*ids[:3], 5}:
        at = [i for i, v in enumerate(ids) if v == t]
        assert s.count(t) == len(at) and s.count(t, 1, max(1, len(ids) - 1)) == sum(1 <= i < max(1, len(ids) - 1) for i in at)
        assert [s.locate(t, k) for k in range(len(at) + 1)] == [*at, -1]
    assert [s.access(i) for i in range(min(20, len(ids)))] == ids[:20]


def test_encoder_gives_the_librarys_ids():
    tokenizers = pytest.importorskip("tokenizers")
    path = token_store.default_tokenizer()
    enc = token_store.Encoder(open(path, encoding="utf-8").read())
    texts = ["", " ", "  ", "a  b", "  x \n y", "a\n\n b\t c", "don't  won't, \"ok.\" 3.14, e.g. x.", "é ü's,", "　a b", "x\x1c y z", "a ", "A,b ,c .", "日本, 語. 12, 5."]
    ref = tokenizers.Tokenizer.from_file(path)
    for _ in range(2):  # cold and cached
        assert [x.tolist() for x in enc.encode(texts)] == [ref.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=7))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_best_run_is_the_least_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, w = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(1, 9))

        def dist(x, y):
            row = list(range(len(y) + 1))
            for i, c in enumerate(x):
                new = [i + 1]
                for j, d in enumerate(y):
                    new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
                row = new
            return row[-1]

        d, s, e = decontaminate.best_run(a, w)
        assert d == min(dist(a, w[i:j]) for i in range(len(w) + 1) for j in range(i, len(w) + 1)) == dist(a, w[s:e])


def test_leaks_with_edits_are_found_and_clean_texts_are_left():
    rng = np.random.default_rng(4)
    items = [rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (12, 20, 33, 40)]
    ix = decontaminate.Index([10, 11, 12, 13], items)
    found = 0
    for k, w in enumerate(items):
        copy = w.copy()
        copy[rng.permutation(len(w))[: len(w) // 4]] = 5
        doc = np.concatenate([rng.integers(1, 1 << 60, 50).astype(np.uint64), copy, rng.integers(1, 1 << 60, 50).astype(np.uint64)])
        found += [x[:2] for x in ix.leaks(doc, np.array([0, len(doc)]))] == [(0, k)]
    assert found >= 3
    clean = rng.integers(1, 1 << 60, 500).astype(np.uint64)
    assert list(ix.leaks(clean, np.array([0, 500]))) == []


def test_models_take_one_class_and_none():
    x = np.zeros((5, 2))
    for y in (np.zeros(0), np.ones(5), np.zeros(5)):
        m = gbt.boost(x[: len(y)], y)
        assert np.isfinite(m.margin(x)).all()
        at, v = gbt.isotonic(m.margin(x[: len(y)]), y)
        assert (np.diff(v) >= 0).all()
        b, w = gbt.lasso_logistic(x[: len(y)], y, 0.01)
        assert np.isfinite(b) and not w.any()
    assert zlib.crc32(b"") == 0
