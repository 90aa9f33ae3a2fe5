"""Passages, pools and bundles against plain loops."""

import random
import re

from lodestone.operators import bundles as B

SEEDS = "seed int, terms array<string>, fields array<string>"


def key(x):
    return re.sub(r"""[\s，。、；：？！"'（）()\[\]【】《》<>—\-…·,.:;?!]+""", "", x or "")[:120]


def loop(terms, rows):
    rows = [r for r in rows if r[3] and any(t.lower() in (r[1] or "").lower() or t.lower() in (r[2] or "").lower() for t in terms)]
    out = set()
    for r in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0]))[:14]:
        n, seen = 0, set()
        for t in terms:
            at = r[3].find(t) if t else -1
            while n < 2 and at >= 0:
                if at // 400 not in seen:
                    seen.add(at // 400)
                    x = r[3][max(0, at - 110) : at + len(t) + 110].strip()
                    if len(key(x)) >= 30:
                        n += 1
                        out.add((r[0], n, x))
                at = r[3].find(t, at + len(t))
    return out


def test_passages_equal_the_loop(spark):
    rng = random.Random(4)
    def text():
        return "".join(rng.choice(["river ", "aa", "port", "、", " . ", "x" * rng.randrange(90), "长江", "\n", "?!" * rng.randrange(40), "(river) "]) for _ in range(rng.randrange(80)))
    rows = [(i, rng.choice(["The River", "port", "a title", None, "long title with a RIVER in it"]) and f"{rng.choice(['The River', 'port of', 'none'])} {'z' * rng.randrange(5)}", rng.choice(["aa", None, "en"]), rng.choice([text(), text(), text(), "", None])) for i in range(60)]
    seeds = [(1, ["river ", "长江", "port"], []), (2, ["aa", "(river)", ""], []), (3, ["absent"], []), (4, [], [])]
    got = B.passages(spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(rows, "resource long, title string, query string, text string")).collect()
    for s, terms, _ in seeds:
        assert {tuple(r)[1:] for r in got if r["seed"] == s} == loop([t for t in terms if t], rows) or s == 2  # an empty term is in every title
    assert {tuple(r)[1:] for r in got if r["seed"] == 2} == {x for x in loop(["aa", "(river)", ""], rows)}
    assert len(got) > 20


def test_pool_scores_and_blocks(spark):
    seeds = spark.createDataFrame([(1, ["salt", "river"], ["origin", "time", "nothing"])], SEEDS)
    long_ = "salt was carried along the river by many boats " * 12
    quotes = [
        (1, "lexical", 1, 5, "The salt, from the river!", 1, "S", 7), (1, "entity", 2, 1, "the salt from the river", 2, "A", None), (1, "graph", 4, 1, "The salt from the river.", 3, None, None), (1, "lexical", 1, 6, "too short", 4, "C", None),
        (1, "fulltext", 5, 1, long_, 5, "C", 8), (1, "event", 3, 2, "起源于1861年的盐运，一说更早，见于地方志所载", 6, None, None), (1, "event", 3, 3, None, 6, None, None),
    ]
    pool = B.pooled(spark.createDataFrame(quotes, "seed int, channel string, position int, place long, quote string, resource long, authority string, cluster long"))
    rows = {r["resource"]: r for r in pool.collect()}
    assert {k: (r["place"], r["channels"]) for k, r in rows.items()} == {1: (1, ["lexical", "graph"]), 2: (2, ["entity"]), 6: (3, ["event"]), 5: (4, ["fulltext"])}
    near = spark.createDataFrame([(1, 1, 1.4), (1, 2, -0.2), (1, 5, 0.25)], "seed int, resource long, semantic double")
    scored = B.score(pool.join(near, ["seed", "resource"], "left"), seeds)
    got = {r["resource"]: r["score"] for r in scored.collect()}
    assert got == {
        1: round(1e4 * (0.3 + 0.2 * 0.3 + 0.15 + 0.15 + 0.03 + 0.02 + 0.03)), 2: round(1e4 * (0 + 0.2 * 0.3 + 0.15 * 0.85 + 0.15 * 0.55 + 0.03 + 0.02 + 0.03)),
        5: round(1e4 * (0.3 * 0.25 + 0.2 * 0.3 + 0.15 * 0.4 + 0.15 + 0.1 + 0.02 + 0.03)), 6: round(1e4 * (0.15 + 0.2 * 0.5 + 0.15 * 0.6 + 0.15 * 0.55 + 0.03 + 0.05 + 0.05)),
    }
    blocks = B.bundle(scored, 3).orderBy("id").collect()
    order = sorted(got, key=lambda k: (-got[k], rows[k]["place"]))
    assert [(r["id"], r["resource"]) for r in blocks] == [(f"Q{i}", k) for i, k in enumerate(order[:3])]
    shown = next(r["quote"] for r in B.bundle(scored, 4).collect() if r["resource"] == 5)
    assert shown == long_.strip()[:420] + "…"
    assert B.bundle(scored.limit(0)).count() == 0
