"""Evaluation of generated answers against the evidence they cite.

An answer is cut into statements; what an answer was assembled from (objects with a status, numbered
evidence) and a judge's verdicts enter as tables.  Statements meet evidence by (answer, number), so the
work is joins on the answer's key; an answer's own lists are bounded by what one assembly holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cities by reach of the river, other waters, words that begin boilerplate, words of mechanisms,
# categories that need one, words of honesty, and the patterns of years, dynasties, admission and citations.
REACHES = {
    "上游": ["宜宾", "泸州", "重庆", "涪陵", "万州"],
    "中游": ["宜昌", "荆州", "沙市", "岳阳", "咸宁", "武汉", "黄石", "鄂州", "黄冈"],
    "下游": ["湖口", "九江", "安庆", "池州", "铜陵", "芜湖", "马鞍山", "南京", "镇江", "扬州", "南通", "上海"],
}
WATERS = "长江汉江嘉陵江岷江乌江湘江赣江雅砻江沱江洞庭湖鄱阳湖太湖巢湖上游中游下游入海口"
BOILERPLATE = ["结构对象", "不确定性", "以下", "综上", "本回答", "第一行", "最后一行"]
MECHANISM = "机制|过程|因为|由于|推动|促进|导致|缘于|借助|依托"
NEEDS_MECHANISM = ["EVOLUTION", "FLOW", "INTERACTION", "HUMAN_ENVIRONMENT"]
NOTHING_FOUND = "证据不足|尚无|暂无|无法"
UNSURE = "证据不足|尚无|不确定|暂无"
YEAR = r"公元前?\s*\d+|\d{3,4}\s*年?"
DYNASTY = "夏|商|西周|东周|春秋|战国|秦|汉|三国|晋|南北朝|隋|唐|宋|元|明|清|晚清|民国|近代|现代|当代"
ADMISSION = r"(?i)已?获?(准入|定名|ADMITTED)|status[=:＝]\s*ADMITTED"
CITATION = r"\[EV:\s*(?:EV?)?(\d+)\s*\]"
IGNORED = r"""[\s，。、；：？！"'（）()\[\]【】《》<>—\-…·,.:;?!]+"""
PLACE = "[" + "".join(sorted({c for names in REACHES.values() for n in names for c in n} | set(WATERS))) + "]{2,6}"
OVERLAP, LEAST_CITED, LEAST_EVIDENCE, LEAST_OBJECTS = 0.35, 2, 3, 2
DIMENSIONS = ["structural_correctness", "evidence_grounding", "citation_entailment", "temporal_coherence", "spatial_coherence", "mechanism_explanation", "uncertainty_honesty"]


def compact(text: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def statements(answer: Column, least: int = 6) -> Column:
    """Trimmed sentences of ``least`` characters and more that don't begin as boilerplate does."""
    cut = F.transform(F.split(F.coalesce(answer, F.lit("")), "[。！？!?\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(cut, lambda x: (F.length(x) >= least) & ~x.rlike("^(" + "|".join(BOILERPLATE) + ")"))


def citations(statement: Column) -> Column:
    """Numbers of cited evidence, [EV:3] or [EV:EV3], as often as they are written."""
    return F.transform(F.regexp_extract_all(statement, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def misplaced(statement: Column) -> Column:
    """How many cities it puts in another reach than theirs; statements on borders of reaches are let through."""
    said = F.regexp_extract(statement, "(上游|中游|下游)", 1)
    wrong = [F.when(F.contains(statement, F.lit(n)) & (said != reach), 1).otherwise(0) for reach, names in REACHES.items() for n in names]
    return F.when((said == "") | F.contains(statement, F.lit("分界")), 0).otherwise(sum(wrong, F.lit(0)))


def assembled(answers: DataFrame, objects: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row an answer with ``objects`` (an array of kind, name, status) and ``quoted`` (an array of n, quote)."""
    named = objects.groupBy("answer_id").agg(F.collect_list(F.struct("kind", "name", "status")).alias("objects"))
    held = evidence.groupBy("answer_id").agg(F.collect_list(F.struct("n", "quote")).alias("quoted"))
    return answers.join(named, "answer_id", "left").join(held, "answer_id", "left")


def split(rows: DataFrame) -> DataFrame:
    """A row a statement of each answer, one of nulls where it has none, with all columns of ``rows``: statement (its number), text, cited,
    uncited (a fact without a citation), misplaced, poisoned."""
    rows = rows.select("*", F.posexplode_outer(statements(F.col("answer"))).alias("statement", "text")).withColumn("cited", citations(F.col("text")))
    held = F.coalesce(F.exists("names", lambda n: F.contains(F.col("text"), n)), F.lit(False))
    poisoned = F.when(F.col("text").rlike(ADMISSION), F.size(F.filter("weak", lambda n: F.contains(F.col("text"), n))))
    uncited = F.when(F.size("cited") == 0, F.col("text").rlike(YEAR) | F.col("text").rlike(PLACE) | held).otherwise(False)
    return rows.select("*", uncited.alias("uncited"), misplaced(F.col("text")).alias("misplaced"), F.coalesce(poisoned, F.lit(0)).alias("poisoned"))


def entailment(cited: DataFrame) -> DataFrame:
    """``cited`` (text, quote, verdict, a row a citation) with supported, null where there is no such evidence: years, dynasties and
    ``OVERLAP`` of the characters are the quote's, or a judge's verdict stands for the characters."""
    known = F.col("quote").isNotNull()
    rows = cited.withColumn("own", F.when(known, compact(F.col("text")))).withColumn("flat", F.when(known, compact(F.col("quote"))))
    rows = rows.withColumn("years", F.when(known, F.regexp_extract_all("text", F.lit(f"({YEAR})"), F.lit(1)))).withColumn("dynasties", F.when(known, F.regexp_extract_all("text", F.lit(f"({DYNASTY})"), F.lit(1))))
    rows = rows.withColumn("chars", F.when(known & F.col("verdict").isNull(), characters(F.col("own"))))
    year_ok = (F.size("years") == 0) | F.exists("years", lambda y: F.contains(F.col("flat"), compact(y)))
    dynasty_ok = (F.size("dynasties") == 0) | F.exists("dynasties", lambda d: F.contains(F.col("quote"), d))
    overlap = F.size(F.array_intersect("chars", F.split("flat", ""))) / F.greatest(F.size("chars"), F.lit(1))
    fits = F.when(F.col("verdict").isNull(), overlap >= OVERLAP).otherwise(F.col("verdict") == "supported")
    return rows.withColumn("supported", F.when(known, year_ok & dynasty_ok & fits)).drop("own", "flat", "years", "dynasties", "chars")


def evaluate(answers: DataFrame, objects: DataFrame, evidence: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Counts, the seven dimensions and the score of answers(answer_id, category, answer, flows), one row a key.

    ``objects`` are (answer_id, kind, name, status), ``evidence`` (answer_id, n, quote); ``flows`` counts flows in the
    assembly.  Null and empty answers have no statements; they can pass no grounding but that of an honest refusal.
    A judge's verdict (answer_id, statement, n, verdict) replaces the overlap."""
    return evaluate_assembled(assembled(answers, objects, evidence), judged)


def evaluate_assembled(rows: DataFrame, judged: DataFrame | None = None, *also: str) -> DataFrame:
    """``evaluate`` of ``assembled`` rows, with the columns ``also`` of them: an answer's own lists stay with it, so that all is
    counted where the answer is, without a join."""
    zero = F.lit(0)
    text = F.coalesce("answer", F.lit(""))
    some = F.filter(F.coalesce("objects", F.array()), lambda o: o["name"] != "")
    weak = F.filter("_named", lambda o: (o["status"] != "ADMITTED") & o["kind"].isin("tradition", "process"))
    known = F.filter(F.coalesce("quoted", F.array()), lambda q: q["n"].isNotNull())
    # of several quotes with a number the least counts: sorted by number and quote, nulls last, the first of each
    quoted = F.array_sort(F.filter("_quoted", lambda q: q["quote"].isNotNull()))
    rows = rows.withColumn("_named", some).withColumn("_quoted", known).select(
        "answer_id", "category", text.alias("answer"), F.coalesce("flows", zero).alias("flows"), *also, F.transform("_named", lambda o: o["name"]).alias("names"), F.transform(weak, lambda o: o["name"]).alias("weak"),
        quoted.alias("quoted"), F.size(F.array_distinct(F.transform("_quoted", lambda q: q["n"]))).cast("long").alias("evidence"))
    answer = F.col("answer")
    rows = rows.withColumn("cited_objects", F.size(F.filter("names", lambda n: F.contains("answer", n))).cast("long")).withColumn("numbers", F.transform("quoted", lambda q: q["n"]))
    rows = rows.withColumn("nothing", answer.rlike(NOTHING_FOUND)).withColumn("unsure", answer.rlike(UNSURE)).withColumn("mechanism", answer.rlike(MECHANISM))
    kept = ["answer_id", *also, "category", "flows", "evidence", "cited_objects", "nothing", "unsure", "mechanism"]
    parts = split(rows).withColumn("valid", F.arrays_overlap("cited", "numbers"))
    cited = parts.select(*kept, "statement", "text", "quoted", "numbers", "uncited", "misplaced", "poisoned", "valid", F.posexplode_outer("cited").alias("place", "n"))
    at = F.coalesce(F.array_position("numbers", F.col("n")).cast("int"), zero) - 1
    cited = cited.withColumn("quote", F.when(at >= 0, F.get("quoted", at)["quote"])).drop("quoted", "numbers")
    if judged is not None:
        cited = cited.join(judged, ["answer_id", "statement", "n"], "left")
    else:
        cited = cited.withColumn("verdict", F.lit(None).cast("string"))
    pairs, first, asked = entailment(cited), F.coalesce("place", zero) == 0, F.col("place").isNotNull()
    once = lambda c: F.sum(F.when(first, F.col(c)).otherwise(0)).cast("long").alias(c)
    numbers = ["claims", "grounded", "fake", "uncited", "entail_ok", "entail_bad", "misplaced", "poisoned", "evidence"]
    rows = pairs.groupBy(*kept).agg(
        F.count_if(first & F.col("statement").isNotNull()).alias("claims"), F.count_if(first & F.col("valid")).alias("grounded"), F.count_if(asked & F.col("quote").isNull()).alias("fake"), F.count_if(first & F.col("uncited")).alias("uncited"),
        F.count_if(asked & F.col("supported")).alias("entail_ok"), F.count_if(asked & ~F.col("supported")).alias("entail_bad"), once("misplaced"), once("poisoned"))
    c = {n: F.col(n) for n in [*numbers, "cited_objects", "flows", "category", "nothing", "unsure", "mechanism"]}
    refused = c["nothing"] & (c["fake"] == 0) & (c["grounded"] == 0)
    needs_doubt = ((c["flows"] == 0) & (c["category"] == "FLOW")) | (c["evidence"] < LEAST_EVIDENCE)
    checks = {
        "structural_correctness": (c["cited_objects"] >= LEAST_OBJECTS) & (c["poisoned"] == 0),
        "evidence_grounding": F.when(c["evidence"] == 0, refused).otherwise((c["claims"] > 0) & (c["fake"] == 0) & (c["uncited"] == 0) & (c["grounded"] >= LEAST_CITED)),
        "citation_entailment": (c["entail_bad"] == 0) & ((c["entail_ok"] >= LEAST_CITED) | (c["entail_ok"] == 0)),
        "temporal_coherence": F.lit(True),  # years and dynasties are part of the entailment
        "spatial_coherence": c["misplaced"] == 0,
        "mechanism_explanation": ~c["category"].isin(NEEDS_MECHANISM) | c["mechanism"],
        "uncertainty_honesty": F.when(F.coalesce(needs_doubt, F.lit(False)), c["unsure"]).otherwise(True),
    }
    out = rows.select("answer_id", *also, *numbers, "cited_objects", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()))
    return out.withColumn("score", F.round(sum((F.col(k).cast("int") for k in DIMENSIONS), F.lit(0)) / len(DIMENSIONS), 3))


def dimension_rates(scored: DataFrame) -> DataFrame:
    """dimension, pass_rate over all answers, with the mean of scores as dimension ``mean_score``."""
    rates = scored.agg(F.round(F.avg("score"), 3).alias("mean_score"), *(F.round(F.avg(F.col(k).cast("int")), 3).alias(k) for k in DIMENSIONS))
    return rates.unpivot([], ["mean_score", *DIMENSIONS], "dimension", "pass_rate")


def family_rates(scored: DataFrame, critical: list[str]) -> DataFrame:
    """family, total, caught, pass_through, critical, with a row a family; an answer is caught that fails a dimension."""
    caught = ~F.expr(" AND ".join(DIMENSIONS))
    rows = scored.groupBy("family").agg(F.count("*").alias("total"), F.count_if(caught).alias("caught"))
    return rows.select("family", "total", "caught", F.round(1 - F.col("caught") / F.col("total"), 4).alias("pass_through"), F.col("family").isin(critical).alias("critical"))


def family_gate(families: DataFrame) -> DataFrame:
    """error_pass_rate over the families that should be caught, and PASS where every critical answer was caught and under one in a hundred got through."""
    rows = families.agg(F.sum("total").alias("total"), F.sum(F.col("total") - F.col("caught")).alias("missed"), F.sum(F.when(F.col("critical"), F.col("total") - F.col("caught")).otherwise(0)).alias("critical_missed"))
    rate = F.round(F.col("missed") / F.col("total"), 4)
    return rows.select("total", "missed", "critical_missed", rate.alias("error_pass_rate"), F.when((F.col("critical_missed") == 0) & (rate < 0.01), "PASS").otherwise("FAIL").alias("gate"))
