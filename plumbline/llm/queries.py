"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm.alignment import op11_alignment
from plumbline.llm.audio import op10_audio_features
from plumbline.llm.decontam import DECONTAMINATE_SQL, op9_decontaminate
from plumbline.llm.html import op8_main_text
from plumbline.llm.lm import op13_language_model
from plumbline.llm.mixing import mixing_sql, op4_mix_sources
from plumbline.llm.neardup import NEAR_DUPLICATES_SQL, op7_near_duplicates
from plumbline.llm.paragraphs import op1_paragraphs
from plumbline.llm.phrases import PHRASES_SQL, op12_phrases
from plumbline.llm.pii import op6_personal_data
from plumbline.llm.quality import op3_quality
from plumbline.llm.substrings import op2_repeated_substrings
from plumbline.llm.tokens import op5_token_records

QUERIES = {
    "op1_paragraphs": op1_paragraphs,
    "op2_repeated_substrings": op2_repeated_substrings,
    "op3_quality": op3_quality,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_records": op5_token_records,
    "op6_personal_data": op6_personal_data,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_main_text": op8_main_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_audio_features": op10_audio_features,
    "op11_alignment": op11_alignment,
    "op12_phrases": op12_phrases,
    "op13_language_model": op13_language_model,
}

ORACLES: dict[str, str] = {
    "op4_mix_sources": mixing_sql(),
    "op7_near_duplicates": NEAR_DUPLICATES_SQL,
    "op9_decontaminate": DECONTAMINATE_SQL,
    "op12_phrases": PHRASES_SQL,
}
