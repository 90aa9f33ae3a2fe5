"""Scores, grades and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(independent: Column, authority: Column, match: Column, has_time: Column, specific: Column, contested: Column) -> Column:
    """Evidence confidence in hundredths, as an exact integer; contested statements have 30, 95 is the cap."""
    steps = F.least(F.greatest(independent - 1, F.lit(0)), F.lit(2))
    raw = F.lit(35) + 15 * steps + F.when(authority.isin("S", "A"), 15).otherwise(0) + F.when(match == "EXACT", 10).otherwise(0) + F.when(has_time, 10).otherwise(0) + F.when(specific, 10).otherwise(0)
    return F.when(contested, 30).otherwise(F.least(raw, F.lit(95))).cast("int")


def coverage_score(claims: Column, independent: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * claims / 10 + 0.5 * independent / 8)


def gap_type(claims: Column, independent: Column, score: Column) -> Column:
    """Grade of a grid cell; null where its coverage is enough."""
    return (
        F.when(claims == 0, "EMPTY").when(independent == 0, "VERY_LOW")
        .when((independent <= 1) & (claims < 3), "SINGLE_SOURCE").when(score < 0.25, "LOW_EVIDENCE")
    )


def gap_priority(kind: Column, independent: Column) -> Column:
    """In tenths, as an exact integer."""
    return F.least(F.lit(10), F.lit(4) + F.when(kind == "EMPTY", 2).otherwise(1) + F.when(independent == 0, 2).otherwise(1)).cast("int")


def gate(sample: Column, violations: Column, least: Column, absent: Column) -> Column:
    return F.when(absent, "FAIL_CAPABILITY_ABSENT").when(sample < least, "NOT_MEASURED").when(violations == 0, "PASS").otherwise("FAIL")


def authority_weight(authority: Column) -> Column:
    return F.when(authority == "S", 1.0).when(authority == "A", 0.85).when(authority == "C", 0.4).otherwise(0.6)
