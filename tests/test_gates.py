"""Rules of the gates on nulls, blanks and each of their branches."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import gates


def values(spark, rule, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("x"))).collect()]


def test_hard_negatives_and_containers(spark):
    assert values(spark, gates.hard_negative, ["G318 路", "app 下载", "都江堰", "", None]) == [True, True, False, False, False]
    assert values(spark, gates.province_container, ["湖北", " 四川省 ", "西藏自治区", "武汉", "", None]) == [True, True, True, False, False, False]


@pytest.mark.parametrize("answer,want", [("KEEP", "KEEP"), ("REJECT", "REJECT"), ("MAYBE", "REJECT"), (None, "REJECT")])
def test_verdict_needs_a_valid_answer(spark, answer, want):
    assert values(spark, lambda x: gates.verdict(x, F.lit(answer).cast("string")), ["都江堰", "收费站"]) == [want, "REJECT"]


def test_scores_keys_and_pieces(spark):
    assert values(spark, gates.unit_score, ["0.25", "7", "-1", "x", "", None]) == [0.25, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, gates.norm_key, ["a, b。c", "x" * 200, "", None]) == ["abc", "x" * 120, "", ""]
    assert values(spark, gates.pieces, ["a、 b ,,c;d；", ",".join(map(str, range(30))), "", None]) == [["a", "b", "c", "d"], [str(i) for i in range(20)], [], []]
    assert values(spark, lambda x: gates.first_held(x, ["b", "a"]), ["ab", "a", "", None]) == ["b", "a", None, None]
