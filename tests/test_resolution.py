"""The funnel of mentions against plain loops."""

import numpy as np
import pytest

from lodestone.operators import resolution as R

MENTIONS = "mention long, name string, type int, vector array<double>, text string"
ENTITIES = "entity long, name string, type int, vector array<double>"


def cos(a, b):
    n = (float(np.dot(a, a)) ** 0.5) * (float(np.dot(b, b)) ** 0.5)
    return float(np.dot(a, b)) / n if n else 0.0


@pytest.mark.parametrize(("dims", "pivots"), [(3, 64), (12, 4)])
def test_similar_equals_all_pairs(spark, monkeypatch, dims, pivots):
    monkeypatch.setattr(R, "PIVOTS", pivots)
    rng = np.random.default_rng(dims)
    centers = rng.normal(size=(6, dims))
    def draw(n):
        return (centers[rng.integers(6, size=n)] + rng.normal(size=(n, dims)) * 0.4).tolist()
    ents = [(i, "e", int(rng.integers(3)), v) for i, v in enumerate(draw(150))] + [(900, "e", 0, [0.0] * dims), (901, "e", None, [1.0] * dims), (902, "e", 1, None)]
    ents += [(500 + i, n, t, v) for i, n, t, v in ents[:20]]  # ties
    ments = [(i, "m", int(rng.integers(4)), v, "") for i, v in enumerate(draw(60))] + [(800, "m", 0, [0.0] * dims, ""), (801, "m", None, [1.0] * dims, ""), (802, "m", 1, None, "")]
    got = {(r["mention"], r["entity"]) for r in R.similar(spark.createDataFrame(ments, MENTIONS), spark.createDataFrame(ents, ENTITIES)).collect()}
    want = set()
    for m, _, t, v, _ in ments:
        pool = sorted((-round(cos(v, w), 9), e) for e, _, u, w in ents if t is not None and u == t and v and w and cos(v, w) >= 0.8)
        want |= {(m, e) for _, e in pool[:3]}
    assert got == want and len({m for m, _ in got}) > 20


def test_every_way_through_the_funnel(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.7, 0.7]
    entities = spark.createDataFrame([(1, "River Town", 0, a), (2, "river town ", 0, a), (3, "Old Port", 0, b), (4, "Guild", 5, b), (5, "Lone", 0, a)], ENTITIES)
    aliases = spark.createDataFrame([(3, "Harbour"), (1, "harbour"), (4, "Harbour")], "entity long, alias string")
    text = "formerly called Old Port, it was rebuilt, then moved"
    mentions = spark.createDataFrame([
        (10, "RIVER TOWN", 0, a, text), (11, "River Town", 0, a, text), (12, "river town", 0, a, text), (13, "harbour", 0, b, text), (14, "New Port", 0, b, text), (15, "New Port", 0, b, text),
        (16, "guild hall", 5, b, text), (17, "nothing", 7, c, text), (18, "far", 0, c, None), (19, None, 0, b, text), (20, "New Port", 0, b, text)], MENTIONS)
    near = R.similar(mentions, entities)
    pairs = R.funnel(mentions, entities, aliases, near)
    staged = {(r["mention"], r["entity"]): r["stage"] for r in pairs.collect()}
    assert staged[10, 1] == staged[10, 2] == "exact" and staged[13, 1] == "alias" and (13, 3) not in staged and staged[14, 3] == "embedding" and not any(m == 17 for m, _ in staged)
    verdicts = spark.createDataFrame([(10, 1, "same"), (10, 2, "same"), (11, 2, "same"), (13, 1, "different"), (16, 4, "same"), (12, 1, "maybe")], "mention long, entity long, verdict string")
    relations = spark.createDataFrame([(12, 1, "predecessor_of", "nowhere in it"), (13, 3, "successor_of", "Old-Port, it was"), (14, 3, "historical_name_of", "called Old Port"), (15, 3, "cousin", "called Old Port"), (19, 3, "NO_RELATION", "")], "mention long, entity long, relation string, quote string")
    got = {r["mention"]: tuple(r)[1:] for r in R.decide(mentions, pairs, verdicts, near, relations, [0]).collect()}
    assert got == {
        10: ("exact", "UNRESOLVED", None, None, None, None, None), 11: ("exact", "MERGED", 2, None, None, None, None), 12: ("exact", "NEW", None, "predecessor_of", 1, False, 0.35),
        13: ("alias", "NEW", None, "successor_of", 3, True, 0.6), 14: ("embedding", "NEW", None, "historical_name_of", 3, True, 0.6), 15: ("embedding", "NEW", None, "UNRESOLVED", 3, False, 0.2),
        16: ("embedding", "MERGED", 4, None, None, None, None), 17: ("no-match", "NEW", None, None, None, None, None), 18: ("no-match", "NEW", None, None, None, None, None),
        19: ("embedding", "NEW", None, "NO_RELATION", 3, False, 0.2), 20: ("embedding", "NEW", None, "UNRESOLVED", 3, False, 0.2),
    }
