"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_secrets import op1_secrets
from .op2_decontamination import op2_decontamination
from .op3_simhash import op3_simhash
from .op4_warc import op4_warc
from .op5_quality import op5_quality_rules
from .op6_bpe import op6_bpe
from .op7_urls import op7_urls
from .op8_substrings import op8_substrings
from .op9_maxent import op9_maxent
from .op10_sharding import op10_sharding
from .oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_simhash, op4_warc, op5_quality_rules, op6_bpe, op7_urls, op8_substrings, op9_maxent, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
