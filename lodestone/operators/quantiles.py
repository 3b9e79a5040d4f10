"""Exact percentiles without bringing a whole group into one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.operators.sizing import small_enough
from lodestone.session import cut_lineage

VALUES_PER_SLICE = 2_000_000


def counted_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, _v, _w``: the distinct non-null values of each group and their rows.

    The only pass over ``df``; all later steps read this narrow table.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    return cut_lineage(rows.groupBy(*by, "_v").agg(F.count("*").alias("_w")))


def _sliced(df: DataFrame, value: str, slices: int | None) -> DataFrame:
    """Cut the value range into slices of about equal numbers of values."""
    if slices is None:
        slices = math.ceil(df.count() / VALUES_PER_SLICE)
    cuts: list[float] = []
    if slices > 1:
        steps = [i / slices for i in range(1, slices)]
        cuts = sorted(set(df.approxQuantile(value, steps, 0.25 / slices)))
    if not cuts:
        return df.withColumn("_slice", F.lit(0.0))
    return Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=value, outputCol="_slice", handleInvalid="keep"
    ).transform(df)


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: Mapping[str, float],
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """One row per group: ``n``, ``max`` and linearly interpolated percentiles.

    Position (n - 1) * p between neighbouring sorted values, as in numpy's default.
    """
    return percentiles_of(counted_values(df, value, by), points, by, slices)


def percentiles_of(
    counted: DataFrame, points: Mapping[str, float], by: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """The same from a table of ``counted_values``.

    First the rows per group and slice are summed; then only the slices that hold a wanted
    position are ranked.
    """
    by = list(by)
    rows = _sliced(counted, "_v", slices)
    counts = cut_lineage(rows.groupBy(*by, "_slice").agg(F.sum("_w").alias("_c"), F.max("_v").alias("_m")))
    # one row per slice of a group
    group = W.partitionBy(*by)
    upto = group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    located = counts.select(
        *by,
        "_slice",
        F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"),
        "_c",
        F.sum("_c").over(group).alias("_n"),
        F.max("_m").over(group).alias("_max"),
    )
    targets = [
        F.struct(
            F.lit(name).alias("point"),
            (F.floor((F.col("_n") - 1) * F.lit(p)) + step).alias("at"),
            F.lit(step).alias("step"),
        )
        for name, p in points.items()
        for step in (0, 1)
    ]
    wanted = (
        located.withColumn("_t", F.explode(F.array(*targets)))
        .withColumn("_at", F.least(F.col("_t.at"), F.col("_n") - 1))
        .filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_c")))
    )
    needed = wanted.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_slice").alias("_k_slice")).distinct()
    if small_enough(needed):
        needed = F.broadcast(needed)
    match = F.col("_slice") == F.col("_k_slice")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    values = rows.join(needed, match, "left_semi")
    in_slice = W.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.sum("_w").over(in_slice)).select(
        *[F.col(c).alias(f"_r_{c}") for c in by], F.col("_slice").alias("_r_slice"), "_v", "_w", "_upto"
    )
    same = F.col("_slice") == F.col("_r_slice")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    inside = F.col("_at") - F.col("_before")
    found = wanted.join(
        ranked, same & (inside >= F.col("_upto") - F.col("_w")) & (inside < F.col("_upto")), "inner"
    )

    def at(name: str, step: int):
        hit = (F.col("_t.point") == name) & (F.col("_t.step") == step)
        return F.max(F.when(hit, F.col("_v")))

    def interpolated(name: str, p: float):
        share = (F.max("_n") - 1) * F.lit(p)
        share = share - F.floor(share)
        return (at(name, 0) + (at(name, 1) - at(name, 0)) * share).alias(name)

    return found.groupBy(*by).agg(
        F.max("_n").alias("n"),
        F.max("_max").alias("max"),
        *[interpolated(name, p) for name, p in points.items()],
    )
