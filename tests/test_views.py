"""Parameters of view functions: absent ones add no filter, pages are clamped; planning on literal names."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import planning
from lodestone.plans import views

DATA = "/root/testdata/sf0.001"


def test_pages_are_clamped():
    assert [views.clamped(*x) for x in ((1, 20), (0, -5), (999, 999))] == [(1, 20), (1, 1), (999, 200)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_parameters_narrow_and_pages_follow_each_other(spark):
    every = views.hydro(spark, DATA, size=200).collect()
    assert len(every) == min(200, every[0]["total"])
    first, second = views.hydro(spark, DATA, page=1, size=15).collect(), views.hydro(spark, DATA, page=2, size=15).collect()
    assert [r["id"] for r in first + second] == [r["id"] for r in every[:30]]
    kind = every[0]["type"]
    some = views.hydro(spark, DATA, kind=kind, size=200).collect()
    assert {r["type"] for r in some} == {kind} and some[0]["total"] == len(some) <= every[0]["total"]
    assert {r["parent"] for r in views.hydro(spark, DATA, parent=3).collect()} == {3}
    assert views.hydro(spark, DATA, page=999, size=999).count() == 0
    claims = views.claim_list(spark, DATA, status=None, predicate="A", most=1000).collect()
    assert len(claims) == 200 and {r["l_returnflag"] for r in claims} == {"A"} and {r["l_linestatus"] for r in claims} == {"F", "O"}
    assert views.entity_list(spark, DATA, search=None, kind="region").count() == 5
    assert views.process_list(spark, DATA, status="nothing").count() == 0


def test_names_waves_and_providers(spark):
    rows = spark.createDataFrame([("汉口开埠", "MISSING_HYDRO_LINK"), ("plain", "unknown kind"), ("", "MISSING_EVIDENCE"), (None, None)], "name string, gap string")
    names = [r[0] for r in rows.select(planning.variants(F.col("name"))).collect()]
    assert names == [["汉口开埠", "武汉", "江汉", "漢口开埠"], ["plain"], [], []]
    waves = rows.select(planning.waves(F.col("name"), F.col("gap")).alias("w")).collect()
    assert waves[0]["w"][0]["queries"] == ["汉口开埠 历史", "武汉 历史", "江汉 历史", "漢口开埠 历史", "汉口开埠 起源", "汉口开埠 沿革", "汉口开埠 考证", "武汉 起源"]
    assert waves[0]["w"][1]["queries"][:7] == [f"汉口开埠 {x}" for x in ("水经注", "一统志", "地方志", "水利", "长江水利委员会", "水文")] + ["武汉 水经注"] and len(waves[0]["w"][1]["queries"]) == 10
    assert waves[1]["w"][1]["queries"][-3:] == ["plain origin 史料", "plain destination 史料", "plain content 史料"]
    assert [len(w["queries"]) for w in waves[2]["w"]] == [0, 0, 0]
    plan = rows.limit(1).select(planning.providers(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("Museum"), F.lit("none"), F.lit("Archive"), F.lit("Gazetteer"), F.lit("Newspaper"))).alias("p")).first()["p"]
    assert [(r["provider"], r["query"]) for r in plan] == [("encyclopedia", "a"), ("encyclopedia", "b"), ("web", "a"), ("web", "b"), ("web", "a 博物馆"), ("web", "b 博物馆"), ("web", "a 档案"), ("web", "b 档案"), ("web", "a 水经注 OR 建置沿革"), ("web", "b 水经注 OR 建置沿革")]
