"""Name normalisation that built-in functions can't express: compatibility forms and full case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def normal_name(c: Column) -> Column:
    """NFKC, case-folded, whitespace runs as one space. ASCII names never leave the JVM's own functions."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(c.isNull(), None).when(ascii_only, F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))).otherwise(F.pandas_udf(_folded, T.StringType())(F.when(~ascii_only, c)))
