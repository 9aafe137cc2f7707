"""Information content of texts."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bits(texts: pd.Series) -> pd.Series:
    """Shannon entropy of each text's characters; counting them in one pass beats a pass for each distinct one on the JVM."""
    return pd.Series([-sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) if t else 0.0 for t in texts], dtype="float64")


def entropy(rows: DataFrame, key: str, text: str, least: float = 2.5) -> DataFrame:
    """(key, n_symbols, entropy, low_info): Shannon entropy of a text's characters, in bits.

    Null and empty texts have none and are of low information.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    measured = rows.select(key, F.length(t).cast("long").alias("n_symbols"), F.pandas_udf(_bits, "double")(t).alias("entropy"))
    return measured.select(key, "n_symbols", F.round("entropy", 6).alias("entropy"), (F.col("entropy") < least).alias("low_info"))
