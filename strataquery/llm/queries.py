"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .class_lm import op7_class_lm
from .fingerprint import op6_fingerprints
from .mixing import OP5_SQL, op5_mix
from .near_dup import op9_near_dup
from .pii import op3_pii
from .quality import op4_quality
from .token_files import op10_token_files
from .topk import OP1_SQL, op1_topk
from .url_filter import OP8_SQL, op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_mix": op5_mix,
    "op6_fingerprints": op6_fingerprints,
    "op7_class_lm": op7_class_lm,
    "op8_url_filter": op8_url_filter,
    "op9_near_dup": op9_near_dup,
    "op10_token_files": op10_token_files,
}
SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op5_mix": OP5_SQL, "op8_url_filter": OP8_SQL}
