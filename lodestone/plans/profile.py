"""Profile of a knowledge base and of its index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lodestone.operators.quantiles import counted_values, percentiles_of
from lodestone.operators.shares import value_counts
from lodestone.plans.index import TextIndex, index_shape
from lodestone.plans.rewrite import redundant_categories


def category_balance(kb: DataFrame) -> DataFrame:
    """Rows per category, and the total as the row without a category name."""
    return kb.rollup("category").agg(F.count("*").alias("n"), F.grouping("category").cast("int").alias("is_total"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its number of nulls, all counted in one pass."""
    names = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "n_null")


def length_summary(df: DataFrame, column: str, slices: int | None = None) -> DataFrame:
    """count, mean, sd, min, quartiles and max of the length of the non-null texts."""
    lengths = df.select(F.char_length(column).alias("len")).filter(F.col("len").isNotNull())
    counted = counted_values(lengths, "len")
    quarters = percentiles_of(counted, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, slices=slices)
    # whole numbers, so that the sums are exact
    v, w = F.col("_v").cast("decimal(10,0)"), F.col("_w").cast("decimal(18,0)")
    sums = counted.agg(
        F.sum("_w").alias("n"), F.sum(v * w).alias("s"), F.sum(v * v * w).alias("q"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    n, s, q = F.col("n").cast("double"), F.col("s").cast("decimal(19,0)"), F.col("q").cast("decimal(26,0)")
    spread = (F.col("n").cast("decimal(12,0)") * q - s * s).cast("double")
    basics = sums.select(
        "n",
        F.round(s.cast("double") / n, 6).alias("mean"),
        F.when(n > 1, F.round(F.sqrt(spread / (n * (n - 1))), 6)).alias("sd"),
        F.col("min").cast("long").alias("min"),
        F.col("max").cast("long").alias("max"),
    )
    # one row on both sides
    return basics.join(quarters.select("n", "q25", "q50", "q75"), "n").select(
        "n", "mean", "sd", "min", "q25", "q50", "q75", "max"
    )


def rarest_terms(vocab: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` terms with the highest idf, ties by term."""
    return vocab.orderBy(F.desc(F.round("idf", 10)), "term").select("term", F.round("idf", 6).alias("idf")).limit(n)


def profile_kb(kb: DataFrame, index: TextIndex, text: str = "description") -> dict[str, DataFrame]:
    return {
        "categories": value_counts(kb, "category"),
        "balance": category_balance(kb),
        "redundant": redundant_categories(kb),
        "nulls": null_counts(kb),
        "lengths": length_summary(kb, text),
        "index_shape": index_shape(index),
        "rarest_terms": rarest_terms(index.vocab),
    }
