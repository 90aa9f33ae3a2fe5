"""Evaluation of answers against a plain evaluator, on the families of wrong answers."""

import re

import pytest

from lodestone.operators import answers as A

EVIDENCE = ["1861年汉口依约开埠，设立江汉关，成为内地通商口岸", "庆历四年春滕子京谪守巴陵郡，重修岳阳楼", "1978年随州曾侯乙墓出土战国编钟六十五件", "李冰父子在岷江主持修建都江堰水利工程", "1986年广汉三星堆祭祀坑出土青铜大立人"]
OBJECTS = [("system", "荆楚文化系统", None), ("hydro", "汉江", None), ("tradition", "荆楚端午传统", "CANDIDATE"), ("process", "汉口开埠", "SUPPORTED"), ("process", "", "SUPPORTED")]
HEAD, TAIL = "结构对象：荆楚文化系统、汉江\n", "。\n不确定性：证据不足。"
TRUE = ["1861年汉口依约开埠，设立江汉关 [EV:EV0]", "滕子京谪守巴陵郡后重修岳阳楼 [EV:1]", "1978年随州曾侯乙墓出土战国编钟 [EV: EV2]"]
CASES = [
    ("TRUE", "FACTUAL", HEAD + "。".join(TRUE) + TAIL), ("FAKE", "FACTUAL", HEAD + "。".join([*TRUE, "汉口开埠后贸易地位上升 [EV:EV77]"]) + TAIL),
    ("UNCITED", "FACTUAL", HEAD + "。".join([*TRUE, "岳阳楼的重修与巴陵郡建置密切相关"]) + TAIL), ("YEAR", "FACTUAL", HEAD + "。".join([*TRUE, "1954年汉口依约开埠，设立江汉关 [EV:EV0]"]) + TAIL),
    ("DYNASTY", "FACTUAL", HEAD + "。".join([*TRUE, "随州曾侯乙墓编钟为宋代礼乐重器 [EV:EV2]"]) + TAIL), ("PLACE", "FACTUAL", HEAD + "。".join([*TRUE, "武汉位于长江下游，汉口依约开埠 [EV:EV0]"]) + TAIL),
    ("BORDER", "FACTUAL", HEAD + "。".join([*TRUE, "宜昌是上游与中游的分界，汉口依约开埠 [EV:EV0]"]) + TAIL), ("UNRELATED", "FACTUAL", HEAD + "。".join([*TRUE, "徽州民居的马头墙具有防火功能 [EV:EV4]"]) + TAIL),
    ("EMPTY FORM", "EVOLUTION", HEAD + "各区域相互促进、共同发展，格局多元一体。\n不确定性：有待研究。"), ("POISON", "FACTUAL", HEAD + "。".join([*TRUE, "汉口开埠已获准入 [EV:EV0]"]) + TAIL),
    ("FLOW", "FLOW", HEAD + "。".join(TRUE) + "。\n不确定性：路线存在争议。"), ("NO MECHANISM", "INTERACTION", HEAD + "。".join(TRUE) + TAIL), ("NOTHING", "FACTUAL", None), ("BLANK", None, ""), ("REFUSED", "FACTUAL", "证据不足，无法作答"),
]


def plain(category, answer, evidence, flows):
    answer, names = answer or "", [n for _, n, _ in OBJECTS if n]
    parts = [x.strip() for x in re.split(r"[。！？!?\n]", answer)]
    parts = [x for x in parts if len(x) >= 6 and not x.startswith(tuple(A.BOILERPLATE))]
    def norm(x):
        return re.sub(A.IGNORED, "", x)
    c = dict.fromkeys(["claims", "grounded", "fake", "uncited", "entail_ok", "entail_bad", "misplaced", "poisoned"], 0)
    for x in parts:
        c["claims"] += 1
        cited = [int(n) for n in re.findall(A.CITATION, x)]
        valid = [n for n in cited if n < len(evidence)]
        c["fake"] += len(cited) - len(valid)
        c["grounded"] += bool(valid)
        if not cited and (any(n in x for n in names) or re.search(A.YEAR, x) or re.search(A.PLACE, x)):
            c["uncited"] += 1
        for n in valid:
            q = evidence[n]
            years, dynasties = re.findall(A.YEAR, x), re.findall(A.DYNASTY, x)
            ok = (not years or any(norm(y) in norm(q) for y in years)) and (not dynasties or any(d in q for d in dynasties))
            ok = ok and len(set(norm(x)) & set(norm(q))) >= 0.35 * max(1, len(set(norm(x))))
            c["entail_ok" if ok else "entail_bad"] += 1
        said = re.search("上游|中游|下游", x)
        c["misplaced"] += sum(bool(said and n in x and said[0] != r and "分界" not in x) for r, ns in A.REACHES.items() for n in ns)
        if re.search(A.ADMISSION, x):
            c["poisoned"] += sum(1 for k, n, s in OBJECTS if n and n in x and k in ("tradition", "process") and s != "ADMITTED")
    held = sum(n in answer for n in names)
    refused = bool(re.search(A.NOTHING_FOUND, answer)) and not c["fake"] and not c["grounded"]
    dims = [
        held >= 2 and not c["poisoned"], (c["claims"] > 0 and not c["fake"] and not c["uncited"] and c["grounded"] >= 2) if evidence else refused,
        not c["entail_bad"] and c["entail_ok"] != 1, True, not c["misplaced"], bool(category is not None and (category not in A.NEEDS_MECHANISM or re.search(A.MECHANISM, answer))),
        bool(re.search(A.UNSURE, answer)) if (not flows and category == "FLOW") or len(evidence) < 3 else True,
    ]
    return (*c.values(), held, *dims, round(sum(dims) / 7, 3))


@pytest.mark.parametrize("n_evidence", [5, 0])
def test_families_against_a_plain_evaluator(spark, n_evidence):
    evidence = EVIDENCE[:n_evidence]
    answers = spark.createDataFrame([(k, c, a, 0) for k, c, a in CASES], "answer_id string, category string, answer string, flows int")
    objects = spark.createDataFrame([(k, kind, n, s) for k, _, _ in CASES for kind, n, s in OBJECTS], "answer_id string, kind string, name string, status string")
    quotes = spark.createDataFrame([(k, i, q) for k, _, _ in CASES for i, q in enumerate(evidence)], "answer_id string, n int, quote string")
    got = {r["answer_id"]: r for r in A.evaluate(answers, objects, quotes).collect()}
    columns = ["claims", "grounded", "fake", "uncited", "entail_ok", "entail_bad", "misplaced", "poisoned", "cited_objects", *A.DIMENSIONS, "score"]
    for k, c, a in CASES:
        assert tuple(got[k][x] for x in columns) == plain(c, a, evidence, 0), k
    if evidence:
        caught = {k for k, r in got.items() if not all(r[d] for d in A.DIMENSIONS)}
        assert caught == {k for k, _, _ in CASES} - {"TRUE"}
        assert got["BORDER"]["spatial_coherence"] and not got["PLACE"]["spatial_coherence"]


def test_a_judge_replaces_the_overlap_only(spark):
    answers = spark.createDataFrame([("a", "FACTUAL", "。".join(TRUE), 1)], "answer_id string, category string, answer string, flows int")
    objects = spark.createDataFrame([], "answer_id string, kind string, name string, status string")
    quotes = spark.createDataFrame([("a", i, q) for i, q in enumerate(EVIDENCE)], "answer_id string, n int, quote string")
    judged = spark.createDataFrame([("a", 0, 0, "unsupported"), ("a", 1, 1, "supported")], "answer_id string, statement int, n int, verdict string")
    r = A.evaluate(answers, objects, quotes, judged).first()
    assert (r["entail_ok"], r["entail_bad"], r["structural_correctness"]) == (2, 1, False)
