"""Queries and SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from lodestone.llm.bpe import op3_bpe
from lodestone.llm.chat import OP2_SQL, op2_chat_format
from lodestone.llm.classifier import op9_quality_classifier
from lodestone.llm.decontam import op5_decontamination
from lodestone.llm.html_text import op8_html_text
from lodestone.llm.line_dedup import op6_line_dedup
from lodestone.llm.packing import op13_packing
from lodestone.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from lodestone.llm.simhash import op7_simhash
from lodestone.llm.substring_dedup import op1_substring_dedup
from lodestone.llm.turn_repair import OP12_SQL, op12_turn_repair
from lodestone.llm.url_filter import OP10_SQL, op10_url_filter
from lodestone.llm.weak_rules import op4_quality_rules


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_chat_format": op2_chat_format,
        "op3_bpe": op3_bpe,
        "op4_quality_rules": op4_quality_rules,
        "op5_decontamination": op5_decontamination,
        "op6_line_dedup": op6_line_dedup,
        "op7_simhash": op7_simhash,
        "op8_html_text": op8_html_text,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_url_filter": op10_url_filter,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_turn_repair": op12_turn_repair,
        "op13_packing": op13_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op10_url_filter": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_turn_repair": OP12_SQL}
