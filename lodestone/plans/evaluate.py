"""Measure search and the intent classifier against labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.scalars import ratio
from lodestone.operators.shares import cross_tab
from lodestone.plans.index import TextIndex
from lodestone.plans.intent import DEFAULT_LEXICON, Lexicon, classify_intent
from lodestone.plans.search import TOP_K, semantic_search

# Fixed value: evaluation counts a query as answered from this score on.
CUT = 0.10


def top_score_per_query(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.max("similarity").alias("top_score"))


def judged(hits: DataFrame, gold: DataFrame, cut: float = CUT) -> DataFrame:
    """``query_id, relevant, predicted`` for every labelled query; no hit means no."""
    best = top_score_per_query(hits)
    predicted = F.coalesce(F.col("top_score"), F.lit(-1.0)) >= cut
    return gold.join(best, "query_id", "left").select("query_id", "relevant", predicted.alias("predicted"))


def confusion(rows: DataFrame) -> DataFrame:
    """TP, FP, TN, FN with precision, recall and F1 (0 where undefined), from relevant and predicted."""
    yes, said = F.col("relevant"), F.col("predicted")
    cells = rows.agg(
        F.count_if(yes & said).alias("TP"),
        F.count_if(~yes & said).alias("FP"),
        F.count_if(~yes & ~said).alias("TN"),
        F.count_if(yes & ~said).alias("FN"),
    )
    rates = cells.withColumn("p", ratio(F.col("TP"), F.col("TP") + F.col("FP"))).withColumn(
        "r", ratio(F.col("TP"), F.col("TP") + F.col("FN"))
    )
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return rates.select(
        "TP", "FP", "TN", "FN",
        F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(f1, 3).alias("f1"),
    )


def evaluate_retrieval(hits: DataFrame, gold: DataFrame, cut: float = CUT) -> DataFrame:
    return confusion(judged(hits, gold, cut))


def score_points(index: TextIndex, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Scores of the best hits per query, four decimals."""
    return semantic_search(index, queries, k).select("query_id", "rank", F.round("similarity", 4).alias("score"))


def evaluate_intent(phrases: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """``esperado, obtido, frase`` for labelled phrases."""
    rows = classify_intent(phrases, lexicon, "frase")
    return rows.select("esperado", F.col("intent").alias("obtido"), "frase")


def intent_table(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Expected against obtained class; unclassified phrases are left out of the cells."""
    return cross_tab(rows, "esperado", "obtido", classes)


def run_summary(results: DataFrame) -> DataFrame:
    """Number of results, how many passed, their total time and the number of classes."""
    return results.agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("n_passed"),
        F.round(F.sum("ms"), 1).alias("total_ms"),
        F.countDistinct("class").alias("n_classes"),
    )
