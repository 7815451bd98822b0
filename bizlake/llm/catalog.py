"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bizlake.llm import attention, chat, credentials, decontamination, jaccard, language, mixing, pii, repetition, runs, templates, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_personal_data": pii.op3_personal_data,
    "op4_language": language.op4_language,
    "op5_line_templates": templates.op5_line_templates,
    "op6_secrets": credentials.op6_secrets,
    "op7_attention_lm": attention.op7_attention_lm,
    "op8_repetition": repetition.op8_repetition,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_chat_format": chat.op11_chat_format,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
SQL: dict[str, str] = {
    "op1_source_mix": mixing.SQL,
    "op2_decontamination": decontamination.SQL,
    "op5_line_templates": templates.SQL,
    "op11_chat_format": chat.SQL,
    "op12_prefix_trie": trie.SQL,
}
