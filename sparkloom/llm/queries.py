"""The queries op1 to op10 and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, language_id, line_dedup, mixing, ngram_join, quality, sharding, substring_dedup, topk_search, url_filter

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_sharding": sharding.op4_sharding,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_language_id": language_id.op8_language_id,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_quality": quality.op10_quality,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op2_url_filter": url_filter.SQL, "op3_decontamination": decontaminate.SQL, "op6_mixing": mixing.SQL}
