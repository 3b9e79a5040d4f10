"""Turning arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def one_per_row(df: DataFrame, keep: Sequence[str], items: Column, name: str) -> DataFrame:
    """One row per non-null item.

    The outer form on purpose: for the plain one Spark infers a filter on the size of the
    array and pushes it to the scan, which works out a costly array twice, the first time
    before any repartitioning.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def fields_per_row(df: DataFrame, keep: Sequence[str], items: Column, first: str) -> DataFrame:
    """The same for structs, whose fields become columns; ``first`` is never null in one."""
    return df.select(*keep, F.inline_outer(items)).filter(F.col(first).isNotNull())
