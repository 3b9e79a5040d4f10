"""Joins against lookup tables that stay safe for large tables and hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F, types as T

from lodestone.session import cut_lineage

# Largest measured size that is broadcast; the session can set its own.
BROADCAST_CONF = "lodestone.broadcastBytes"
BROADCAST_BYTES = 48 * 1024 * 1024
FULL_PART_BYTES = 128 * 1024 * 1024
# A table of at most this size is dealt anew where it comes in few parts.
SMALL_BYTES = 1024 * 1024 * 1024
# A key with more than this share of the rows, or a quarter of a mean partition, is salted.
HOT_SHARE = 0.001
MIN_SALTS = 16


def measured_bytes(df: DataFrame) -> int:
    """Size of a table of plain columns: text by its bytes, anything else 16 bytes."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    per_row = 16 * len(df.columns)
    sizes = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide), F.lit(per_row))
    return df.agg(F.coalesce(F.sum(sizes.cast("long")), F.lit(0)).alias("b")).first()["b"]


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_CONF, str(BROADCAST_BYTES)))


def small_enough(df: DataFrame) -> bool:
    return measured_bytes(df) <= broadcast_limit(df)


def hot_keys(facts: DataFrame, on: Sequence[str], share: float | None = None) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, at most 1 / share of them, with ``_salts`` in proportion."""
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(HOT_SHARE, 0.25 / partitions) if share is None else share
    counts = cut_lineage(facts.groupBy(*on).agg(F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    salts = F.ceil(4 * F.col("_n") * partitions / max(total, 1)).cast("int")
    return counts.filter(F.col("_n") > share * total).select(*on, F.greatest(salts, F.lit(2)).alias("_salts"))


def salted_sides(
    facts: DataFrame, table: DataFrame, on: Sequence[str], salt_on: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: rows of hot keys spread over it, the table's repeated.

    The salt is a hash of columns that tell rows apart, so a retried task gives the same
    rows. Other keys keep salt 0 and are not repeated; null keys match nothing and are
    spread as well.
    """
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = cut_lineage(hot_keys(facts, on))
    if small_enough(hot):
        hot = F.broadcast(hot)
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    salts = F.when(no_key, F.lit(max(MIN_SALTS, partitions))).otherwise(F.col("_salts"))
    spread = F.pmod(F.xxhash64(*salt_on), salts).cast("int")
    left = facts.join(hot, list(on), "left")
    left = left.withColumn("_salt", F.coalesce(spread, F.lit(0)))
    right = table.join(hot, list(on), "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return left.drop("_salts"), right.drop("_salts")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_on: Sequence[str] = (),
) -> DataFrame:
    """Join many rows to a lookup table.

    A table of measured small size is broadcast: no shuffle of ``facts``, so hot keys do
    not matter. Otherwise both sides are shuffled on the key plus a salt, which cuts up
    the hot keys of ``facts``.
    """
    on = list(on)
    if small_enough(table):
        return facts.join(F.broadcast(table), on, how)
    salted, copies = salted_sides(facts, table, on, list(salt_on or facts.columns))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def few_parts(df: DataFrame) -> bool:
    """Whether a small table comes from its files in fewer parts than there are cores.

    Small by Spark's estimate of its bytes, whatever the number of cores. A plan with a
    shuffle would have to run to tell its parts; there the estimate alone decides.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    estimate = int(str(execution.optimizedPlan().stats().sizeInBytes()))
    if estimate > SMALL_BYTES or execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return estimate < min(SMALL_BYTES, cores * FULL_PART_BYTES)
    return df.rdd.getNumPartitions() < cores


def on_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that comes in few parts; leave others alone.

    A small file is often one row group, and its text work would run in a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if few_parts(df) else df
