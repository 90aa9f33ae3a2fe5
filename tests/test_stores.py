"""Graph files, vocabularies and staged resources: literal cases, swaps, and restarts."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import seeds as S
from lodestone.sources import graphml
from lodestone.streaming import stages

GRAPH = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d2" for="node" attr.name="rank" attr.type="int"/>
  <key id="d7" for="edge" attr.name="weight" attr.type="double"/><key id="d9" for="edge" attr.name="rank" attr.type="string"/>
  <graph edgedefault="undirected">
    <node id="长江"><data key="d0">River &amp; basin</data><data key="d2">7</data></node>
    <node id="b"><data key="d2">seven</data><data key="unknown">x</data></node>
    <node id="c"/>
    <edge source="长江" target="b"><data key="d7">1.5</data><data key="d9">a;b</data></edge>
    <edge source="b" target="nowhere"></edge>
  </graph>
</graphml>"""


def test_graph_files_are_typed_as_declared(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH, encoding="utf-8")
    path = f"file://{tmp_path}/g.graphml"
    n, e = graphml.nodes(spark, path), graphml.edges(spark, path)
    assert dict(n.dtypes) == {"id": "string", "entity_type": "string", "rank": "int"} and dict(e.dtypes) == {"source": "string", "target": "string", "weight": "double", "rank": "string"}
    assert sorted((tuple(r) for r in n.select("id", "entity_type", "rank").collect()), key=repr) == sorted([("长江", "River & basin", 7), ("b", None, None), ("c", None, None)], key=repr)
    assert sorted((tuple(r) for r in e.select("source", "target", "weight", "rank").collect()), key=repr) == sorted([("长江", "b", 1.5, "a;b"), ("b", "nowhere", None, None)], key=repr)


NAMES = "name string, parent string, description string"


def test_vocabularies_are_applied_whole_or_not(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    first = spark.createDataFrame([("root", None, "r"), ("old a", "root", "a"), ("b", "old a", "b"), ("c", "b", "c"), ("stale", "root", "s"), ("loop 1", "loop 2", "as stored")], NAMES)
    none = spark.createDataFrame([], "old string, new string")
    assert {r["action"] for r in S.apply(first, store, none).collect()} == {"INSERT", "REFUSE"}
    assert {r["name"] for r in S.current(spark, store).collect()} == {"root", "old a", "b", "c", "stale"}
    S.swap(first, store)
    seed = spark.createDataFrame([("root", None, "r"), ("new a", "root", "a"), ("b", "new a", "b"), ("c", "b", "changed"), ("d", "c", "d"), ("loop 1", "loop 2", "x"), ("loop 2", "loop 1", "x"), ("under", "loop 1", "x"), ("lost", "nobody", "x")], NAMES)
    renames = spark.createDataFrame([("old a", "new a"), ("old a", "other"), ("never", "root"), ("stale", "root")], "old string, new string")
    want = {"root": ("KEEP", 0), "new a": ("RENAME", 1), "b": ("KEEP", 2), "c": ("UPDATE", 3), "d": ("INSERT", 4), "stale": ("DELETE", None), "loop 1": ("REFUSE", None), "loop 2": ("REFUSE", None), "under": ("REFUSE", None), "lost": ("REFUSE", None)}
    before = sorted(map(tuple, S.current(spark, store).collect()), key=repr)
    dry = S.apply(seed, store, renames, dry_run=True)
    assert {r["name"]: (r["action"], r["level"]) for r in dry.collect()} == want
    assert sorted(map(tuple, S.current(spark, store).collect()), key=repr) == before
    S.apply(seed, store, renames)
    assert {r["name"]: r["description"] for r in S.current(spark, store).collect()} == {"root": "r", "new a": "a", "b": "b", "c": "changed", "d": "d", "loop 1": "as stored"}
    again = {r["name"]: r["action"] for r in S.apply(seed, store, renames).collect()}
    assert set(again.values()) == {"KEEP", "REFUSE"}


def test_a_failed_write_leaves_the_store(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    S.swap(spark.createDataFrame([("a", None, "a")], NAMES), store)
    with pytest.raises(Exception):
        S.swap(S.current(spark, store).select("name", "parent", F.raise_error(F.lit("lost")).cast("string").alias("description")), store)
    assert [tuple(r) for r in S.current(spark, store).collect()] == [("a", None, "a")]
    assert S.current(spark, f"file://{tmp_path}/none") is None


def test_manifests_are_of_content(spark):
    rows = [(f"n{i}", f"n{i // 2}" if i else None, "x" * (i % 3)) for i in range(300)]
    a = spark.createDataFrame(rows, NAMES)
    b = spark.createDataFrame([(d, p, n) for n, p, d in reversed(rows)], "description string, parent string, name string").repartition(5)
    assert S.manifest(a) == S.manifest(b) != S.manifest(a.limit(299))
    assert S.manifest(a) != S.manifest(a.withColumn("parent", F.coalesce("parent", F.lit(""))))


@pytest.mark.parametrize("at", [1, 3])
def test_a_kill_between_stages_changes_no_row(spark, tmp_path, at):
    good = "A sentence that is long enough to be a quote. Another one follows here, and it is also long."
    docs = spark.createDataFrame([(i, [good * (1 + 20 * i), "x" * 3000, "", None, good][i % 5]) for i in range(20)], "resource long, text string")
    judged = spark.createDataFrame([(i, "CORE" if i % 3 else "REJECT") for i in range(17)], "resource long, role string")
    whole = stages.knowledge_stages(judged)
    want = sorted(map(tuple, stages.advance(docs, 0, f"file://{tmp_path}/whole", whole).drop("batch").collect()))
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda s: stages.staging(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), f"file://{tmp_path}/cut", str(tmp_path / "cp"), s).trigger(availableNow=True).start()
    name, stage = whole[at]
    cut = [*whole[:at], (name, lambda rows: stage(rows).withColumn("part", F.raise_error(F.lit("killed")).cast("int"))), *whole[at + 1 :]]
    with pytest.raises(Exception):
        stream(cut).awaitTermination()
    stream(whole).awaitTermination()
    stream(whole).awaitTermination()  # nothing new
    got = spark.read.parquet(f"file://{tmp_path}/cut/DONE").drop("batch")
    assert sorted(map(tuple, got.collect())) == want and want
    logs = [sorted((r["resource"], r["position"], r["stage"], r["result"]) for r in stages.log(spark, f"file://{tmp_path}/{x}").collect()) for x in ("whole", "cut")]
    assert logs[0] == logs[1] and len(logs[0]) == len(set(logs[0])) and {r[3] for r in logs[0]} == {"PASS", "STOP"}
