"""The registered queries of this subpackage and the SQL that some of them can be told in."""

from __future__ import annotations

from .byte_bpe import op12_byte_bpe
from .decontamination import op9_benchmark_decontamination
from .jaccard_join import OP4_SQL, op4_ngram_jaccard_join
from .line_dedup import op8_line_dedup
from .lm_scoring import op2_backoff_scores
from .packing import op10_pattern_packing
from .quality_rules import op6_quality_rules
from .secret_scans import OP5_SQL, op5_secret_scans
from .spelling_variants import OP13_SQL, op13_spelling_variants
from .token_alignment import op11_token_alignment
from .token_blocks import op1_token_blocks
from .toxicity import op7_toxicity
from .url_filters import OP3_SQL, op3_url_filters

QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_backoff_scores": op2_backoff_scores,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_secret_scans": op5_secret_scans,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_pattern_packing": op10_pattern_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op3_url_filters": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_secret_scans": OP5_SQL, "op13_spelling_variants": OP13_SQL}
