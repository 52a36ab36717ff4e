"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP10_SQL, op10_chat_format
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .language_id import op1_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .packing import op4_best_fit_packing
from .pii import op9_pii
from .secrets import op2_secret_scan
from .sentencepiece_codec import op8_sentencepiece
from .simhash import op3_simhash_near_dedup
from .topk import OP6_SQL, op6_exact_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii": op9_pii,
    "op10_chat_format": op10_chat_format,
}

#: The other queries can't be told in SQL, or not fast enough over whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op6_exact_top_k": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op10_chat_format": OP10_SQL,
}
