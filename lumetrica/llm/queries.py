"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import op11_collocations
from .decontamination import op4_decontamination
from .divergence import op12_source_divergence
from .document_fingerprints import op8_document_fingerprints
from .html_extraction import op13_html_extraction
from .language_id import op6_language_id
from .license_scan import op9_license_scan
from .lm_scoring import op10_lm_scoring
from .oracles import ORACLE_SQL as _SQL
from .oracles import QUERIES as _PARTS
from .sentencepiece import op1_sentencepiece
from .sharding import op5_sharding
from .simhash import op7_simhash_dedup
from .token_counts import op2_token_counts
from .url_filter import op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_html_extraction": op13_html_extraction,
    **_PARTS,
}

ORACLE_SQL: dict[str, str] = dict(_SQL)
