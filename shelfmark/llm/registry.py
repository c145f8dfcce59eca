"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .decontamination import OP6_SQL, op6_decontamination
from .html_extraction import op10_html_extraction
from .importance_resampling import OP12_SQL, op12_importance_resampling
from .language_id import op1_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .ngram_join import OP5_SQL, op5_ngram_join
from .packing import op2_packing
from .personal_data import OP13_SQL, op13_personal_data
from .quality_rules import op9_quality_rules
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .suffix_dedup import OP7_SQL, op7_suffix_dedup
from .token_alignment import op11_token_alignment
from .url_filters import OP8_SQL, op8_url_filters

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_alignment": op11_token_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL = {
    "op3_line_dedup": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_personal_data": OP13_SQL,
}
