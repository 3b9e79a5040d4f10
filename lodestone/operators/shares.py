"""Dense axes, histograms and shares: the numbers behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.scalars import ratio


def dense_axis(counts: DataFrame, axis: str, size: int, value: str = "n") -> DataFrame:
    """One row for each of 0 .. size-1, 0 where nothing was counted."""
    spark = counts.sparkSession
    full = spark.range(size).select(F.col("id").cast("int").alias(axis))
    # at most ``size`` rows on both sides
    return full.join(counts.withColumn(axis, F.col(axis).cast("int")), axis, "left").select(
        axis, F.coalesce(value, F.lit(0)).cast("long").alias(value)
    )


def share_of_total(counts: DataFrame, value: str, name: str = "share", digits: int = 6) -> DataFrame:
    whole = counts.agg(F.sum(value)).scalar()
    return counts.withColumn(name, F.round(ratio(F.col(value), whole), digits))


def share_of_max(counts: DataFrame, value: str, name: str = "scale", digits: int = 6) -> DataFrame:
    top = counts.agg(F.max(value)).scalar()
    return counts.withColumn(name, F.round(ratio(F.col(value), top), digits))


def histogram(
    df: DataFrame, value: str, bins: int = 10, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Fixed-width counts with clamped ends: ``bin, mid, n`` for every bin."""
    v = F.col(value).cast("double")
    ends = df.agg(
        F.lit(lo).cast("double").alias("lo") if lo is not None else F.coalesce(F.min(v), F.lit(0.0)).alias("lo"),
        F.lit(hi).cast("double").alias("hi") if hi is not None else F.coalesce(F.max(v), F.lit(1.0)).alias("hi"),
    ).select("lo", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    place = F.least(F.greatest((v - low) / (high - low) * F.lit(bins), F.lit(0.0)), F.lit(bins - 1.0))
    counted = (
        df.filter(v.isNotNull())
        .select(place.cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    width = (high - low) / F.lit(bins)
    return dense_axis(counted, "bin", bins).select(
        "bin", F.round(low + (F.col("bin") + 0.5) * width, 4).alias("mid"), "n"
    )


def cross_tab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts of rows x columns for a fixed list of column values; others are left out."""
    table = df.groupBy(rows).pivot(columns, list(values)).count()
    return table.na.fill(0, subset=[str(v) for v in values])


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))
