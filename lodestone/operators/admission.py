"""Ten-stage admission of claims with a log of every stage, over all drafts at once.

A draft is rejected at the first stage it fails; later stages are not logged.  What a draft meets of earlier
ones follows from their order: for a predicate with one object, the first draft of a subject that passes
decides the object, and others are contested; support counts the admitted drafts of the same claim that
came before, and the draft itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .staging import staged

STAGES = ["schema_validation", "entity_resolution", "domain_range", "evidence_span", "temporal", "spatial", "scope", "source_independence", "conflict_detection", "admission"]
ADMITTED_SCOPES = ["CORE", "CONTEXT"]
FALLBACK = "associated_with"
#: Drafts of a claim are counted in blocks of so many ids, so that a frequent claim is no single task.
BLOCK = 1 << 16


def failed_stage(match: Column) -> Column:
    """The first of the stages that can reject, from a draft's columns joined with its predicate's; null where none does."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return (
        F.when(F.col("cardinality").isNull(), STAGES[0])
        .when(F.col("subject").isNull() | F.col("object").isNull() | (F.coalesce("subject_state", F.lit("")) == "UNRESOLVED") | (F.coalesce("object_state", F.lit("")) == "UNRESOLVED"), STAGES[1])
        .when(~F.coalesce(F.array_contains("domain", F.col("subject_type")), F.lit(False)) | ~F.coalesce(F.array_contains("range", F.col("object_type")), F.lit(False)), STAGES[2])
        .when(match == "FAILED", STAGES[3])
        .when(F.col("time_required") & blank("time_text"), STAGES[4])
        .when(F.col("place_required") & F.col("place").isNull(), STAGES[5])
        .when(~F.coalesce(F.col("scope").isin(ADMITTED_SCOPES), F.lit(False)), STAGES[6])
    )


def _before(rows: DataFrame, flags: list[str], keys: list[str]) -> DataFrame:
    """Rows with the sums of each flag over rows of the same keys with a lesser id."""
    at = Window.partitionBy(*keys, "_block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_block", F.floor(F.col("id") / BLOCK))
    totals = rows.groupBy(*keys, "_block").agg(*(F.sum(f).alias(f"_{f}") for f in flags)).select(*keys, "_block", *(F.coalesce(F.sum(f"_{f}").over(blocks), F.lit(0)).alias(f"_{f}") for f in flags))
    return rows.join(totals, [*keys, "_block"]).select(*rows.columns, *((F.coalesce(F.sum(f).over(at), F.lit(0)) + F.col(f"_{f}")).alias(f"{f}_before") for f in flags)).drop("_block")


def _judged(drafts: DataFrame, predicates: DataFrame) -> DataFrame:
    """Drafts with their predicate's columns, match and failed_stage."""
    rows = drafts.join(F.broadcast(predicates), "predicate", "left").withColumn("match", text.bind(F.col("quote"), F.col("chunk")))
    return rows.withColumn("failed_stage", failed_stage(F.col("match"))).drop("quote", "chunk", "domain", "range")


def _contested(passing: DataFrame) -> DataFrame:
    """``passing`` with conflict_with: the draft that decided another object of a subject's single-valued predicate."""
    first = passing.where("cardinality = 'single'").groupBy("subject", "predicate").agg(F.min(F.struct("id", "object")).alias("first"))
    return passing.join(first, ["subject", "predicate"], "left").withColumn("conflict_with", F.when(F.col("object") != F.col("first.object"), F.col("first.id"))).drop("first")


def _status() -> Column:
    rejected = F.when((F.col("failed_stage") == STAGES[1]) & (F.col("subject").isNull() | F.col("object").isNull()), "REJECTED_PRE_INSERT").otherwise("REJECTED")
    return F.when(F.col("failed_stage").isNotNull(), rejected).when(F.col("conflict_with").isNotNull(), "CONTESTED").otherwise("ADMITTED")


def statuses(drafts: DataFrame, predicates: DataFrame) -> DataFrame:
    """id, status, failed_stage of ``admit``, without the support, for which drafts must be counted."""
    rows = staged(_judged(drafts, predicates).select("id", "subject", "object", "predicate", "cardinality", "failed_stage"), "drafts")
    out = _contested(rows.where("failed_stage IS NULL")).unionByName(rows.where("failed_stage IS NOT NULL").withColumn("conflict_with", F.lit(None).cast(rows.schema["id"].dataType)))
    return out.select("id", _status().alias("status"), "failed_stage")


def admit(drafts: DataFrame, predicates: DataFrame) -> DataFrame:
    """id, status, failed_stage, match, confidence (hundredths), independent, resources, sources, evidence, conflict_with.

    ``drafts``: id (an order without equals), subject, object, predicate, subject_type, object_type, subject_state,
    object_state, quote, chunk, time_text, place, scope, resource, cluster, source, authority.  ``predicates`` (a vocabulary,
    broadcast): predicate, cardinality, domain, range, time_required, place_required.  Nulls fail the stage that needs them;
    a draft without an endpoint is REJECTED_PRE_INSERT.  A resource in no cluster is its own."""
    rows = staged(_judged(drafts, predicates), "drafts")
    passing = _contested(rows.where("failed_stage IS NULL"))
    unit = F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("resource "), F.col("resource").cast("string")))
    kept = staged(passing.where("conflict_with IS NULL").select("id", "subject", "predicate", "object", "resource", "source", unit.alias("unit"), F.lit(1).alias("evidence")), "admitted")
    claim = ["subject", "predicate", "object"]
    counted = kept
    for name, what in (("independent", "unit"), ("resources", "resource"), ("sources", "source")):
        new = kept.where(F.col(what).isNotNull()).groupBy(*claim, what).agg(F.min("id").alias("id")).select("id", F.lit(1).alias(name))
        counted = counted.join(new, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    names = ["independent", "resources", "sources", "evidence"]
    counted = _before(counted, names, claim).select("id", *(F.col(f"{n}_before").alias(n) for n in names))
    out = rows.join(passing.select("id", "conflict_with"), "id", "left").join(counted, "id", "left")
    contested = F.col("conflict_with").isNotNull()
    support = {n: F.when(F.col("failed_stage").isNull(), F.coalesce(n, F.lit(0)) + 1).otherwise(0) for n in names}
    has_time = F.coalesce(F.col("time_text").cast("string"), F.lit("")) != ""
    value = scoring.confidence(support["independent"], F.coalesce("authority", F.lit("UNKNOWN")), F.col("match"), has_time, F.col("predicate") != FALLBACK, contested)
    return out.select("id", _status().alias("status"), "failed_stage", F.when(F.col("failed_stage").isNull(), F.col("match")).otherwise("FAILED").alias("match"), F.when(F.col("failed_stage").isNull(), value).otherwise(0).alias("confidence"), *(support[n].alias(n) for n in names), "conflict_with")


def stage_log(decisions: DataFrame) -> DataFrame:
    """id, position, stage, result: the stages a draft went through, the failed one last.  A draft without an endpoint has
    only the stages before."""
    stages = F.array(*(F.lit(s) for s in STAGES))
    last = F.when(F.col("failed_stage").isNull(), len(STAGES)).otherwise(F.array_position(stages, F.col("failed_stage")).cast("int") - F.when(F.col("status") == "REJECTED_PRE_INSERT", 1).otherwise(0))
    rows = decisions.select("id", "failed_stage", F.posexplode(F.slice(stages, F.lit(1), last)).alias("position", "stage"))
    return rows.select("id", "position", "stage", F.when(F.col("stage") == F.col("failed_stage"), "FAIL").otherwise("PASS").alias("result"))


def audit(decisions: DataFrame, rule_version: str) -> DataFrame:
    """One audit row a draft: kind, id, decision, rule_version and a deterministic key, so that writing again changes nothing."""
    key = F.concat(F.lit("adm-"), F.substring(F.sha1(F.concat_ws("|", F.lit("claim"), F.col("id").cast("string"), "status", F.lit(rule_version))), 1, 16))
    return decisions.select(key.alias("key"), F.lit("claim").alias("kind"), "id", F.col("status").alias("decision"), F.lit(rule_version).alias("rule_version"), F.coalesce("failed_stage", F.lit("")).alias("reason"))


EVENT_STAGES = ["event_schema_validation", "entity_resolution", "time_validation", "place_validation", "participant_validation", "evidence_validation", "scope", "conflict_detection", "admission"]


def admit_events(events: DataFrame) -> DataFrame:
    """id, status, failed_stage, match, conflict_with of events(id, name, type, entity, time_text, period, place, participants, quote, chunk, scope).

    Of events of one name and type that pass, the first is admitted and the others are contested with it; blank texts are missing."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    rows = events.withColumn("match", text.bind(F.col("quote"), F.col("chunk")))
    failed = (
        F.when(blank("name") | blank("type"), EVENT_STAGES[0]).when(F.col("entity").isNull(), EVENT_STAGES[1]).when(blank("time_text") & blank("period"), EVENT_STAGES[2]).when(blank("place"), EVENT_STAGES[3])
        .when(F.coalesce("participants", F.lit(0)) == 0, EVENT_STAGES[4]).when(F.col("match") == "FAILED", EVENT_STAGES[5]).when(~F.coalesce(F.col("scope").isin(ADMITTED_SCOPES), F.lit(False)), EVENT_STAGES[6])
    )
    rows = staged(rows.withColumn("failed_stage", failed).select("id", "name", "type", "match", "failed_stage"), "events")
    first = rows.where("failed_stage IS NULL").groupBy("name", "type").agg(F.min("id").alias("first"))
    out = rows.join(first, ["name", "type"], "left").withColumn("conflict_with", F.when(F.col("failed_stage").isNull() & (F.col("id") != F.col("first")), F.col("first")))
    status = F.when(F.col("failed_stage").isNotNull(), "REJECTED").when(F.col("conflict_with").isNotNull(), "CONTESTED").otherwise("ADMITTED")
    return out.select("id", status.alias("status"), "failed_stage", "match", "conflict_with")
