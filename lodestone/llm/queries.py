"""Named queries of this folder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adaptive_clusters, decontaminate, jaccard_join, line_dedup, mixing, piece_codec, quality_classifier, quality_rules, quote_linking, token_store, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_quote_linking": quote_linking.op4_quote_linking,
        "op4_conversations": quote_linking.op4_conversations,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_token_store": token_store.op6_token_store,
        "op7_warc": warc.op7_warc,
        "op8_mixing": mixing.op8_mixing,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_centroid_clusters": adaptive_clusters.op11_centroid_clusters,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_piece_codec": piece_codec.op13_piece_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quote_linking": quote_linking.SQL,
        "op5_jaccard_join": jaccard_join.SQL,
        "op7_warc": warc.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op10_quality_rules": quality_rules.SQL,
        "op11_centroid_clusters": adaptive_clusters.SQL,
        "op12_vector_codes": vector_codes.SQL,
    }
