"""Scores of judges against gold answers, and the gates on them, from tables of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_SYSTEMS = ["CANDIDATE", "REJECT", "ERROR"]


def majority(votes: DataFrame) -> DataFrame:
    """case, verdict: the most frequent of votes(case, run, vote) that aren't ERROR, of equals the one seen first; ERROR where there is none."""
    counted = votes.where("vote <> 'ERROR'").groupBy("case", "vote").agg(F.count("*").alias("n"), F.min("run").alias("first"))
    best = counted.groupBy("case").agg(F.min_by("vote", F.struct(-F.col("n"), F.col("first"), F.col("vote"))).alias("verdict"))
    return votes.select("case").distinct().join(best, "case", "left").select("case", F.coalesce("verdict", F.lit("ERROR")).alias("verdict"))


def ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.greatest(b, F.lit(1)), 4)


def graded(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """cases(case, family, expected, system, accept, systems) with verdict, admit (a system was named) and ok.

    An expected admission is right with one of ``systems`` where they are given, else with ``system`` or one that is accepted;
    CANDIDATE is right where it is accepted or several systems are possible.  Whatever else is expected is right without a system."""
    rows = cases.join(verdicts, "case", "left").withColumn("verdict", F.coalesce("verdict", F.lit("ERROR")))
    admit = ~F.col("verdict").isin(NOT_SYSTEMS)
    several = F.coalesce(F.size("systems"), F.lit(0)) > 0
    accepted = F.coalesce(F.array_contains("accept", F.col("verdict")), F.lit(False))
    right = F.when(admit & several, F.array_contains("systems", F.col("verdict"))).when(admit, (F.col("verdict") == F.col("system")) | accepted).when(F.col("verdict") == "CANDIDATE", accepted | several).otherwise(False)
    return rows.withColumn("admit", admit).withColumn("ok", F.when(F.col("verdict") == "ERROR", False).when(F.col("expected") == "ADMIT", F.coalesce(right, F.lit(False))).otherwise(~admit))


def scores(rows: DataFrame, border: str = "border", targets: tuple[float, float, float] = (0.97, 0.90, 0.93)) -> DataFrame:
    """One row: cases, errors, tp, fp, fn, tn, precision, recall, f1, border_honesty, gate.  Errors are in no count of these four."""
    answered, wanted = F.col("verdict") != "ERROR", F.col("expected") == "ADMIT"
    n = rows.agg(
        F.count("*").alias("cases"), F.count_if(~answered).alias("errors"), F.count_if(answered & wanted & F.col("ok")).alias("tp"), F.count_if(answered & ~wanted & F.col("admit")).alias("fp"), F.count_if(answered & wanted & ~F.col("ok")).alias("fn"),
        F.count_if(answered & ~wanted & ~F.col("admit")).alias("tn"), F.count_if((F.col("expected") == "CANDIDATE") & (F.col("verdict") == "CANDIDATE")).alias("honest"), F.count_if(F.col("family") == border).alias("border"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    ok = (p >= targets[0]) & (r >= targets[1]) & (f1 >= targets[2])
    return n.select("cases", "errors", "tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"), ratio(F.col("honest"), F.col("border")).alias("border_honesty"), F.when(ok, "PASS").otherwise("FAIL").alias("gate"))


def families(rows: DataFrame) -> DataFrame:
    """family, total, ok, rate."""
    return rows.groupBy("family").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok")).select("family", "total", "ok", ratio(F.col("ok"), F.col("total")).alias("rate"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row of rows(rule, verdict): how often a judge upholds what a rule admitted, and what it left a candidate."""
    ruled = F.col("rule") == "ADMITTED"
    n = rows.agg(F.count_if(ruled).alias("admitted"), F.count_if(ruled & F.col("verdict").rlike("^(ADMIT|S)")).alias("upheld"), F.count_if(~ruled).alias("candidates"), F.count_if(~ruled & F.col("verdict").isin("CANDIDATE", "REJECT")).alias("left"), F.count_if(F.col("verdict") == "ERROR").alias("errors"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    return n.select("admitted", "upheld", rate("upheld", "admitted").alias("admitted_precision"), "candidates", "left", rate("left", "candidates").alias("candidate_uphold"), "errors")


def gap_precision(rows: DataFrame, target: float = 0.90) -> DataFrame:
    """One row of rows(kind, verdict): real gaps judged TRUE and injected ones judged otherwise, without errors, among all."""
    true, real = F.col("verdict") == "TRUE", F.col("kind") == "real"
    n = rows.agg(F.count("*").alias("total"), F.count_if(real & true).alias("real_true"), F.count_if(~real & ~true & (F.col("verdict") != "ERROR")).alias("injected_rejected"), F.count_if(F.col("verdict") == "ERROR").alias("errors"))
    p = (F.col("real_true") + F.col("injected_rejected")) / F.greatest(F.col("total"), F.lit(1))
    return n.select("total", "real_true", "injected_rejected", "errors", F.round(p, 4).alias("gap_precision"), F.when(p >= target, "PASS").otherwise("FAIL").alias("gate"))


def scope_accuracy(rows: DataFrame) -> DataFrame:
    """One row of rows(expected, got): accuracy and the rate of accepted rejects, with a gate on both."""
    same = F.col("expected") == F.coalesce("got", F.lit("REJECT"))
    n = rows.agg(F.count("*").alias("cases"), F.count_if(same).alias("right"), F.count_if(~same & (F.col("expected") == "REJECT")).alias("false_accept"))
    accuracy, wrong = F.col("right") / F.greatest(F.col("cases"), F.lit(1)), F.col("false_accept") / F.greatest(F.col("cases"), F.lit(1))
    return n.select("cases", F.round(accuracy, 3).alias("accuracy"), F.round(wrong, 3).alias("false_accept_rate"), F.when((accuracy >= 0.95) & (wrong <= 0.05), "PASS").otherwise("FAIL").alias("gate"))


def overall(gates: DataFrame) -> DataFrame:
    """One row of gates(gate, status): FAIL if any fails, else NOT_MEASURED if any isn't measured, else PASS; and which."""
    failed = F.col("status").startswith("FAIL")
    n = gates.agg(F.array_sort(F.collect_list(F.when(failed, F.col("gate")))).alias("f"), F.array_sort(F.collect_list(F.when(F.col("status") == "NOT_MEASURED", F.col("gate")))).alias("m"))
    return n.select(F.when(F.size("f") > 0, "FAIL").when(F.size("m") > 0, "NOT_MEASURED").otherwise("PASS").alias("overall"), F.array_join("f", ",").alias("failed"), F.array_join("m", ",").alias("not_measured"))
