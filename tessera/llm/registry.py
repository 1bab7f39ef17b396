"""Queries of the corpus operators and the pipeline, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op10_pruned_graph
from .factors import OP5_SQL, op5_factor_dedup
from .importance import op2_importance_resampling
from .langid import op9_ppm_language
from .media import op1_media_columns
from .mixing import op7_entropy_mix
from .packing import op8_binary_pack
from .simhash import op6_covering_simhash
from .suffixes import OP3_SQL, op3_suffix_dedup
from .warc import OP4_SQL, op4_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_importance_resampling, op3_suffix_dedup, op4_warc_revisits, op5_factor_dedup, op6_covering_simhash, op7_entropy_mix, op8_binary_pack, op9_ppm_language, op10_pruned_graph)}
SQL: dict[str, str] = {"op3_suffix_dedup": OP3_SQL, "op4_warc_revisits": OP4_SQL, "op5_factor_dedup": OP5_SQL}
