"""Repeatable random draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.scalars import draw


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """``n`` rows drawn by a hash of their key (each task keeps only its own best ``n``)."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)
