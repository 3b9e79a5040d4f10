"""Running numbers over tables too large for one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.operators.sizing import lookup_join
from lodestone.session import cut_lineage

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row in partition below


def with_sequence(
    df: DataFrame, order_by: Sequence[str], name: str = "seq", within: Sequence[str] = ()
) -> DataFrame:
    """Number the rows 1, 2, 3, … in order, over all rows or within each group.

    ``order_by`` has to identify a row (within its group). The rows are range-partitioned
    and sorted in place, so a hot group is cut over many tasks; only one count per
    partition and one start per group are exchanged afterwards.
    """
    keys = [*within, *order_by]
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _POSITION_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_id")
    )
    # one row per partition, so the ordered window below is small
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )
    if not within:
        return numbered
    # null groups are numbered as a group of their own
    groups = [f"_g{i}" for i in range(len(within))]
    keyed = numbered
    for group, column in zip(groups, within):
        keyed = keyed.withColumn(group, F.struct(F.col(column).alias("v")))
    starts = keyed.groupBy(*groups).agg(F.min(name).alias("_start"))
    return (
        lookup_join(keyed, starts, groups, "inner", salt_on=list(order_by))
        .withColumn(name, F.col(name) - F.col("_start") + 1)
        .drop("_start", *groups)
    )
