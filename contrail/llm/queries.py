"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_crf, langid, line_dedup, lsh_forest, packing, pii, quality, ranked_search, repetition, revisits, spelling, token_blocks


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        packing.op1_cost_balanced_packing,
        revisits.op2_revisit_resolution,
        langid.op3_hierarchical_language,
        line_dedup.op4_site_spread_lines,
        decontamination.op5_prefix_filtered_decontamination,
        lsh_forest.op6_lsh_forest,
        html_crf.op7_crf_main_text,
        repetition.op8_suffix_array_repetition,
        quality.op9_pu_quality,
        token_blocks.op10_patched_blocks,
        ranked_search.op11_bit_sliced_search,
        spelling.op12_partenum_spelling,
        pii.op13_weak_supervision_pii,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op2_revisit_resolution": revisits.SQL, "op4_site_spread_lines": line_dedup.SQL, "op11_bit_sliced_search": ranked_search.SQL, "op12_partenum_spelling": spelling.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
