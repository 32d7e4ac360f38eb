"""The queries of the training-data operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .html_extract import op3_html_extraction
from .knn_join import OP2_SQL, op2_knn_join
from .lm_scoring import op10_lm_scoring
from .near_dedup import op1_minhash_near_dedup
from .packing import op6_sequence_packing
from .quality_rules import OP5_SQL, op5_quality_rules
from .token_rollup import op8_token_counts
from .toxicity import op4_toxicity
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_knn_join": op2_knn_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_sequence_packing": op6_sequence_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_lm_scoring": op10_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op2_knn_join": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "op9_url_filter": OP9_SQL,
}
