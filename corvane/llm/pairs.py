"""What the operators on drug-pair rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import bare, valid_drug_id

DIGEST_SEEDS = (0, 1)


def valid_pairs(rows: DataFrame) -> DataFrame:
    return rows.filter(valid_drug_id("DDInterID_A") & valid_drug_id("DDInterID_B"))


def id_pair(a: str = "DDInterID_A", b: str = "DDInterID_B") -> list[Column]:
    """The two bare ids in order, so that both side orders give the same."""
    x, y = bare(a), bare(b)
    return [F.least(x, y).alias("low_id"), F.greatest(x, y).alias("high_id")]
