"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontamination import op9_benchmark_decontamination
from .hard_negatives import op12_hard_negatives
from .html_extraction import op7_html_extraction
from .jaccard_join import op8_ngram_jaccard_join
from .language_model import op5_lm_scoring
from .line_dedup import op11_line_dedup
from .oracle import ORACLE_SQL
from .privacy import op6_pii_sanitisation
from .quality import op2_quality_classifier
from .quality_rules import op10_quality_rules
from .sentencepiece_codec import op4_sentencepiece
from .spelling import op13_spelling_variants
from .substring_dedup import op1_substring_dedup
from .toxicity import op3_toxicity

QUERIES = {
    q.__name__: q
    for q in (
        op1_substring_dedup,
        op2_quality_classifier,
        op3_toxicity,
        op4_sentencepiece,
        op5_lm_scoring,
        op6_pii_sanitisation,
        op7_html_extraction,
        op8_ngram_jaccard_join,
        op9_benchmark_decontamination,
        op10_quality_rules,
        op11_line_dedup,
        op12_hard_negatives,
        op13_spelling_variants,
    )
}


__all__ = ["ORACLE_SQL", "QUERIES"]
