"""Cases the operators once left out."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, line_dedup, mixing, quote_linking


def test_branches_follow_in_reply_order(spark, tmp_path):
    rng = random.Random(3)
    parent, rows = {}, []
    for c in (1, 2):
        for t in range(40):
            p = rng.choice([None, *range(t)]) if t > 2 else t - 1 if t else None
            parent[c, t] = p
            rows.append((c, t, "user", (f"> said {c} {p} here\n" if p is not None else "") + f"said {c} {t} here"))
    p = None
    for t in range(0, 3000, 300):  # a chain over several blocks, and late replies to its first message
        rows.append((3, t, "user", (f"> three {p} x\n" if p is not None else "") + f"three {t} x"))
        parent[3, t], p = p, t
    for t in (2000, 2500):
        rows.append((3, t, "user", f"> three 0 x\nthree {t} x"))
        parent[3, t] = 0
    rows += [(None, 1, "user", "x"), (4, None, "user", "y")]

    def walk(c, t):
        return [t, *(x for u in sorted(u for d, u in parent if d == c and parent[d, u] == t) for x in walk(c, u))]

    want = [(c, r, x) for c in (1, 2, 3) for r in sorted(t for d, t in parent if d == c and parent[d, t] is None) for x in walk(c, r)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = quote_linking.conversations(df).collect()
    assert [(r["conv_id"], r["thread"], r["turn"]) for r in got if r["conv_id"] in (1, 2, 3)] == want
    assert all(r["thread"] == r["root_turn"] for r in got) and len(got) == len(rows)
    counted = {}
    for r in got:
        if r["conv_id"] in (1, 2, 3):
            assert r["position"] == counted.get((r["conv_id"], r["thread"]), 0)
            counted[r["conv_id"], r["thread"]] = r["position"] + 1
    plain = quote_linking.op4_quote_linking(spark, str(tmp_path))
    assert [(r["conv_id"], r["turn"]) for r in plain.collect() if r["conv_id"] in (1, 2, 3)] == [(c, t) for c, _, t in want]


def test_lines_of_rows_without_their_own_id(spark):
    base = [f"w{i}" for i in range(30)]
    near, far = " ".join([*base[:29], "z"]), " ".join(f"v{i}" for i in range(30))
    docs = [(None, far + "\nclean one"), (None, " ".join(base) + "\nclean two"), (None, None), (None, ""), (5, near + "\n" + far + "\nkept"), (7, "same id\n" + far + " more"), (7, "other text\n" + near), (8, "x\nx"), (8, "x\nx")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = [r[0] for r in df.select(line_dedup.row(F.col("text"))).collect()]
    every = []
    for (d, t), h in set(zip(docs, hashes, strict=True)):
        for n, line in enumerate((t or "").split("\n")):
            w = line.split()
            every.append(((d is not None, d or 0, h, n), (d, t), set(w)))
    every.sort(key=lambda x: x[0])
    want = {x: [] for x in docs}
    for k, (at, x, s) in enumerate(every):
        if s and any(y and 100 * len(s & y) >= 75 * len(s | y) for _, _, y in every[:k]):
            want[x].append(at[-1])
    assert want[5, docs[4][1]] == [0, 1] and want[docs[0]] == want[docs[1]] == []
    got = sorted(((r["doc_id"], r["removed"]) for r in line_dedup.deduplicated(df).collect()), key=repr)
    assert got == sorted(((d, v) for (d, _), v in want.items()), key=repr)
    kept = sorted(((d, t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d, t])) for d, t in docs), key=repr)
    assert sorted((tuple(r) for r in line_dedup.without_removed(df).collect()), key=repr) == kept


def test_filter_keeps_what_each_item_size_may_leak():
    long_, short = [f"a{i}" for i in range(16)], [f"b{i}" for i in range(15)]
    copy = [f"x{i}" if i in (2, 6, 10, 13) else w for i, w in enumerate(long_)]
    words = decontaminate.item_words(pa.array([" ".join(x) for x in (long_, short, copy)]))
    index = decontaminate.Index([1, 2], words[:2])
    assert index.suspects(words[2], np.array([0, 16])).tolist() == [0]


def test_short_items_leak_by_exact_copies(spark):
    docs = spark.createDataFrame([(1, "it is a Short, item here; a short item"), (2, "a short"), (3, "item"), (4, "one"), (None, "so one"), (5, None), (6, "a b c d e f g"), (7, "a b c d x f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a short item"), (2, "One"), (3, "a b c d e f g"), (4, "item a"), (5, "")], "item_id long, text string")
    want = {(1, 1, 0, 2, 3), (4, 2, 0, 0, 1), (None, 2, 0, 1, 1), (6, 3, 0, 0, 7)}
    assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == want


def test_mixing_has_all_domains(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i % 80}w{j}" for j in range(12)), f"l{i % 80}") for i in range(320)], "doc_id long, text string, lang string")
    out, report = mixing.rates(docs)
    assert len(report["domains"]) == 80 and (report["target"] > 0).all()
    assert abs(report["reached"] - report["target"]).max() <= 0.001 * report["target"].max()
    best = {r["doc_id"]: report["domains"][int(np.argmax(r["p"]))] for r in out.select("doc_id", "p").collect()}
    assert sum(best[i] == f"l{i % 80}" for i in best) >= 0.9 * len(best)
