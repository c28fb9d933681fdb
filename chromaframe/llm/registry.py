"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chromaframe.llm import decontamination, exact_dedup, katz, licenses, ngram_join, packing, periodic, pii, quality, resampling, simhash, token_counts, token_files
from chromaframe.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: decontamination.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_token_counts": lambda s, d: token_counts.query(table(s, d, "documents"), BYTE_BPE),
        "op3_ngram_join": lambda s, d: ngram_join.query(table(s, d, "documents")),
        "op4_pii": lambda s, d: pii.query(table(s, d, "documents")),
        "op5_packing": lambda s, d: packing.pack(table(s, d, "documents"), WORD_BPE),
        "op6_exact_dedup": lambda s, d: exact_dedup.query(table(s, d, "documents")),
        "op7_token_files": lambda s, d: token_files.query(table(s, d, "documents"), BYTE_BPE),
        "op8_licenses": lambda s, d: licenses.query(table(s, d, "documents")),
        "op9_quality": lambda s, d: quality.query(table(s, d, "documents"), table(s, d, "labels")),
        "op10_katz": lambda s, d: katz.query(table(s, d, "documents")),
        "op11_resampling": lambda s, d: resampling.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_periodic": lambda s, d: periodic.query(table(s, d, "documents")),
        "op13_simhash": lambda s, d: simhash.query(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.SQL,
        "op3_ngram_join": ngram_join.SQL,
        "op6_exact_dedup": exact_dedup.SQL,
        "op11_resampling": resampling.SQL,
        "op12_periodic": periodic.SQL,
    }
