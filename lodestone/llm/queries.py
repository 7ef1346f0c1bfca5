"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import collocations, langid, lines, outliers, packing, pieces, pii, quality, simhash, spelling, topk, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_personal_data": pii.op3_personal_data,
        "op4_language_id": langid.op4_language_id,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_embedding_near_dedup": vectors.op6_embedding_near_dedup,
        "op7_quality_rules": outliers.op7_quality_rules,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "op11_topk_search": topk.op11_topk_search,
        "op12_collocations": collocations.op12_collocations,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": lines.OP9_SQL, "op11_topk_search": topk.OP11_SQL, "op12_collocations": collocations.OP12_SQL}
