"""Queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op4_decontaminate
from .html_extract import op1_html_extract
from .language_id import op7_language_id
from .packing import op6_best_fit
from .pii import op8_pii
from .secret_scan import op5_secret_scan
from .simhash import op9_simhash
from .toxicity import op10_toxicity
from .vector_topk import OP3_SQL, op3_vector_topk
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extract, op2_warc, op3_vector_topk, op4_decontaminate, op5_secret_scan, op6_best_fit, op7_language_id, op8_pii, op9_simhash, op10_toxicity)
}
ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op3_vector_topk": OP3_SQL}
