"""Queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .embedding_dedup import SQL as OP1_SQL
from .embedding_dedup import op1_embedding_dedup
from .packing import op4_packing
from .pii import op5_pii
from .preferences import SQL as OP3_SQL
from .preferences import op3_preferences
from .quality_classifier import op2_quality_classifier
from .quality_rules import op10_quality_rules
from .simhash import op9_simhash
from .substring_dedup import SQL as OP8_SQL
from .substring_dedup import op8_substring_dedup
from .warc import SQL as OP7_SQL
from .warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_dedup, op2_quality_classifier, op3_preferences, op4_packing, op5_pii, op6_bpe, op7_warc, op8_substring_dedup, op9_simhash, op10_quality_rules)}
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op3_preferences": OP3_SQL, "op7_warc": OP7_SQL, "op8_substring_dedup": OP8_SQL}
