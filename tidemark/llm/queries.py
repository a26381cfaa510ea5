"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import conversation_repair, line_dedup
from tidemark.llm.alignment import op11_token_alignment
from tidemark.llm.bpe_codec import op1_bpe_codec
from tidemark.llm.language_id import op4_language_id
from tidemark.llm.licences import op3_licence_scan
from tidemark.llm.lm_score import op8_lm_score
from tidemark.llm.media import op5_media
from tidemark.llm.near_dedup import op9_near_dedup
from tidemark.llm.nearest import op10_nearest
from tidemark.llm.packing import op7_packing
from tidemark.llm.token_count import op2_token_counts
from tidemark.llm.toxicity import op12_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_token_counts": op2_token_counts,
    "op3_licence_scan": op3_licence_scan,
    "op4_language_id": op4_language_id,
    "op5_media": op5_media,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_lm_score": op8_lm_score,
    "op9_near_dedup": op9_near_dedup,
    "op10_nearest": op10_nearest,
    "op11_token_alignment": op11_token_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
