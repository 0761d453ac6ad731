"""The text operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import alignment, bpe, cover_tree, isolation, lang_cnn, merkle, near_dedup, packing, quality_em, runs, suffix_dedup, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_merkle_fingerprint": merkle.op1_merkle_fingerprint,
        "op2_cover_tree": cover_tree.op2_cover_tree,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_language_id": lang_cnn.op6_language_id,
        "op7_arc_to_warc": warc.op7_arc_to_warc,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_weak_quality": quality_em.op9_weak_quality,
        "op10_bpe_round_trip": bpe.op10_bpe_round_trip,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_isolation_rules": isolation.op12_isolation_rules,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_cover_tree": cover_tree.OP2_SQL, "op5_suffix_dedup": suffix_dedup.OP5_SQL, "op7_arc_to_warc": warc.OP7_SQL, "op8_near_dedup": near_dedup.OP8_SQL}
