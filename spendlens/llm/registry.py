"""Registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm.arrow_tokens import op9_arrow_tokens
from spendlens.llm.bm25_leaks import op8_bm25_leaks
from spendlens.llm.chat_format import op13_chat_format
from spendlens.llm.hash_ring import op7_hash_ring
from spendlens.llm.hnsw import op1_hnsw
from spendlens.llm.importance_resample import op12_importance_resample
from spendlens.llm.knn_quality import op5_knn_quality
from spendlens.llm.license_scan import SQL as LICENSE_SQL
from spendlens.llm.license_scan import op2_license_scan
from spendlens.llm.merkle_audit import SQL as MERKLE_SQL
from spendlens.llm.merkle_audit import op3_merkle_audit
from spendlens.llm.signature_tree import op6_signature_tree
from spendlens.llm.spelling_variants import op11_spelling_variants
from spendlens.llm.suffix_dedup import op10_suffix_dedup
from spendlens.llm.word_bpe import op4_word_bpe

_QUERIES = [op1_hnsw, op2_license_scan, op3_merkle_audit, op4_word_bpe, op5_knn_quality, op6_signature_tree,
            op7_hash_ring, op8_bm25_leaks, op9_arrow_tokens, op10_suffix_dedup, op11_spelling_variants,
            op12_importance_resample, op13_chat_format]
_SQL = {"op2_license_scan": LICENSE_SQL, "op3_merkle_audit": MERKLE_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
