"""Queries of the training-data operators and their DuckDB twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.op1_bpe import op1_bpe
from auditlake.llm import op5_chat
from auditlake.llm.op10_search import op10_search
from auditlake.llm.op11_repair import op11_repair
from auditlake.llm.op12_negatives import op12_negatives
from auditlake.llm.op13_jaccard import op13_jaccard
from auditlake.llm.op2_quality import op2_quality
from auditlake.llm.op3_licenses import op3_licenses
from auditlake.llm.op4_suffix_dedup import op4_suffix_dedup
from auditlake.llm.op5_chat import op5_perspectives
from auditlake.llm.op6_language import op6_language
from auditlake.llm.op7_secrets import op7_secrets
from auditlake.llm.op8_neardup import op8_neardup
from auditlake.llm.op9_packing import op9_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_licenses, op4_suffix_dedup, op5_perspectives, op6_language, op7_secrets, op8_neardup, op9_packing, op10_search, op11_repair, op12_negatives, op13_jaccard)}


def oracle_sql() -> dict[str, str]:
    return {"op5_perspectives": op5_chat.SQL}
