"""Tolerant JSON against a plain parser, and admission against the plain loop over drafts."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import tolerant
from lodestone.operators import admission as A


def some_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 2:
        return rng.choice(["", "a", 'q"u', "b\\c", "x, y}", "[z", "长江，", "line\nend", "t\tab"])
    if kind < 5:
        return rng.choice([0, -3, 1.5, True, False, None, 10**12])
    if kind == 5:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return some_object(rng, depth + 1)


def some_object(rng, depth=0):
    return {rng.choice("abcdef") + str(i): some_value(rng, depth + 1) for i in range(rng.randrange(1, 5))}


def cut(text):
    """The longest prefix that ends where an element is whole, closed; by trying every prefix with json.loads."""
    for n in range(len(text), 0, -1):
        due, quoted, escaped = [], False, False
        for c in text[:n]:
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{[":
                due.append("}" if c == "{" else "]")
            elif c in "}]":
                due.pop()
        if not quoted and (text[n - 1] in "}]" or text[n : n + 1] == ","):
            return json.loads(text[:n] + "".join(reversed(due)))
    return None


def test_written_json_is_read(spark):
    rng, rows, want = random.Random(3), [], []
    for _ in range(150):
        o = some_object(rng)
        t = json.dumps(o, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        at = rng.randrange(1, len(t))
        for x, w in ((t, o), (f"```json\n{t}\n```", o), (f"```{t}```", o), (f"So: {t}. Done", o), (t[:-1] + ",}", o), (t[:at], cut(t[:at])), ("Cut: " + t[:at], cut(t[:at]))):
            rows.append((len(rows), x))
            want.append(w)
    for x, w in ((None, None), ("", None), ("  ", None), ("no json @@@ {{", None), ("[1, 2]", [1, 2]), ("7", 7), ("{", None), ("}{", None), ('{"a"', None), ('{"a": 1, "b": [2, {"c": "d', {"a": 1, "b": [2]})):
        rows.append((len(rows), x))
        want.append(w)
    got = spark.createDataFrame(rows, "i int, x string").select("i", F.to_json(tolerant.parsed(F.col("x"))).alias("v")).orderBy("i").collect()
    for r, (_, x), w in zip(got, rows, want, strict=True):
        assert (None if r["v"] is None else json.loads(r["v"])) == w, x


PREDICATES = [("one", "single", ["P"], ["Q"], True, False), ("many", "multi", ["P"], ["Q"], False, True), ("associated_with", "multi", ["P"], ["Q"], False, False)]
DRAFT = "id long, subject long, object long, predicate string, subject_type string, object_type string, subject_state string, object_state string, quote string, chunk string, time_text string, place string, scope string, resource long, cluster long, source string, authority string"


def loop(drafts):
    """Drafts one by one, each seeing what was admitted before."""
    rules, admitted, out = {p: r for p, *r in PREDICATES}, [], {}
    for d in drafts:
        (i, s, o, p, st, ot, ss, os_, q, ch, tm, pl, sc, res, cl, src, au) = d
        r = rules.get(p)
        bound = "EXACT" if q and ch and q in ch else "FAILED"
        checks = [r is None, s is None or o is None or "UNRESOLVED" in (ss, os_), r and not (st in r[1] and ot in r[2]), bound == "FAILED", r and r[3] and not tm, r and r[4] and pl is None, sc not in ("CORE", "CONTEXT")]
        if any(checks):
            k = next(k for k, c in enumerate(checks) if c)
            out[i] = ("REJECTED_PRE_INSERT" if k == 1 and (s is None or o is None) else "REJECTED", A.STAGES[k], 0, 0, 0, 0, 0, None)
            continue
        other = [x for x in admitted if r[0] == "single" and x[1] == s and x[3] == p and x[2] != o]
        same = [x for x in admitted if (x[1], x[2], x[3]) == (s, o, p)]
        n = [len({("c", x[14]) if x[14] is not None else ("r", x[13]) for x in same}) + 1, len({x[13] for x in same}) + 1, len({x[15] for x in same} - {None}) + 1, len(same) + 1]
        c = 30 if other else min(95, 35 + 15 * min(2, n[0] - 1) + (15 if au in ("S", "A") else 0) + 10 + (10 if tm else 0) + (0 if p == "associated_with" else 10))
        out[i] = ("CONTESTED" if other else "ADMITTED", None, c, *n, other[0][0] if other else None)
        if not other:
            admitted.append(d)
    return out


def test_drafts_are_admitted_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 16)  # several blocks a claim
    rng = random.Random(9)
    pick = lambda good, *bad: good if rng.random() < 0.93 else rng.choice(bad)
    drafts = [
        (i, pick(rng.randrange(4), None), pick(rng.randrange(3), None), pick(rng.choice(["one", "many", "associated_with"]), "none", None), pick("P", "Q", None), pick("Q", None), pick(None, "UNRESOLVED"), pick("NEW", "UNRESOLVED"),
         pick("said so", "else", "", None), pick("it said so there", None, ""), pick("1900", None, ""), pick("x", None), pick("CORE", "REJECTED", None), rng.randrange(40), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice(["S", "A", "C", None]))
        for i in range(400)
    ]
    got = A.admit(spark.createDataFrame(drafts, DRAFT).repartition(3), spark.createDataFrame(PREDICATES, "predicate string, cardinality string, domain array<string>, range array<string>, time_required boolean, place_required boolean"))
    rows = {r["id"]: (r["status"], r["failed_stage"], r["confidence"], r["independent"], r["resources"], r["sources"], r["evidence"], r["conflict_with"]) for r in got.collect()}
    assert rows == loop(drafts)
    assert {r[0] for r in rows.values()} == {"ADMITTED", "CONTESTED", "REJECTED", "REJECTED_PRE_INSERT"} and {r[1] for r in rows.values()} == {None, *A.STAGES[:7]}
    log = {}
    for r in A.stage_log(got).orderBy("id", "position").collect():
        log.setdefault(r["id"], []).append((r["stage"], r["result"]))
    for i, (status, failed, *_) in rows.items():
        k = len(A.STAGES) if failed is None else A.STAGES.index(failed) + (status != "REJECTED_PRE_INSERT")
        assert log.get(i, []) == [(s, "FAIL" if s == failed else "PASS") for s in A.STAGES[:k]]
    assert A.audit(got, "v1").select("key").distinct().count() == 400


def test_one_event_of_a_name_and_type_is_admitted(spark):
    fields = "id long, name string, type string, entity long, time_text string, period string, place string, participants int, quote string, chunk string, scope string"
    event = lambda i, **other: tuple(({"id": i, "name": "n", "type": "t", "entity": 1, "time_text": "1900", "period": None, "place": "x", "participants": 1, "quote": "said so", "chunk": "it said so", "scope": "CORE"} | other).values())
    events = [event(1, name=" "), event(2, entity=None), event(3, time_text=None), event(4), event(5, time_text=None, period="p"), event(6, type="u"), event(7, quote="other"), event(8, scope=None), event(9, participants=None), event(10, place="")]
    got = {r[0]: tuple(r)[1:3] + (r["conflict_with"],) for r in A.admit_events(spark.createDataFrame(events, fields)).collect()}
    stage = A.EVENT_STAGES
    rejected = {1: 0, 2: 1, 3: 2, 7: 5, 8: 6, 9: 4, 10: 3}
    assert got == {i: ("REJECTED", stage[n], None) for i, n in rejected.items()} | {4: ("ADMITTED", None, None), 5: ("CONTESTED", None, 4), 6: ("ADMITTED", None, None)}
