"""Registered queries of the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fumarole.llm import oracles
from fumarole.llm.byte_bpe import op7_byte_bpe
from fumarole.llm.chat import op1_chat_windows
from fumarole.llm.clustering import op12_centroids
from fumarole.llm.decontamination import op9_decontamination
from fumarole.llm.filter_audit import op11_filter_audit
from fumarole.llm.minhash import op13_minhash
from fumarole.llm.quality_classifier import op8_quality_classifier
from fumarole.llm.quality_rules import op2_quality_rules
from fumarole.llm.simhash import op4_simhash
from fumarole.llm.substrings import op5_substrings
from fumarole.llm.token_files import op6_token_files
from fumarole.llm.toxicity import op10_toxicity
from fumarole.llm.url_lists import op3_url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run
    for run in [
        op1_chat_windows,
        op2_quality_rules,
        op3_url_lists,
        op4_simhash,
        op5_substrings,
        op6_token_files,
        op7_byte_bpe,
        op8_quality_classifier,
        op9_decontamination,
        op10_toxicity,
        op11_filter_audit,
        op12_centroids,
        op13_minhash,
    ]
}

SQL: dict[str, str] = dict(oracles.SQL)
