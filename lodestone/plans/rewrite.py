"""Hand out rule variants in turn to the rows of each category."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.text import category_key
from lodestone.operators.ordering import with_sequence
from lodestone.operators.sizing import lookup_join


def turn_in_category(kb: DataFrame) -> DataFrame:
    """``doc_id, cat_norm, turn``: place of a row within its category, from 0, in table order."""
    keyed = kb.select("doc_id", category_key(F.col("category")).alias("cat_norm"))
    numbered = with_sequence(keyed, ["doc_id"], "turn", ["cat_norm"])
    return numbered.withColumn("turn", F.col("turn") - 1)


def assigned_slots(kb: DataFrame, variants: DataFrame) -> DataFrame:
    """``doc_id, cat_norm, slot``: the variant each row of a known category gets."""
    sizes = variants.groupBy(category_key(F.col("category")).alias("cat_norm")).agg(F.count("*").alias("n_variants"))
    turns = lookup_join(turn_in_category(kb), sizes, ["cat_norm"], "inner", ["doc_id"])
    return turns.select("doc_id", "cat_norm", F.pmod("turn", "n_variants").alias("slot"))


def rewrite_kb(kb: DataFrame, variants: DataFrame) -> DataFrame:
    """``kb`` with rule and action replaced in turn; other categories stay as they are.

    ``variants``: category, slot (0 .. n-1 within the category), rule, action.
    """
    texts = variants.select(
        category_key(F.col("category")).alias("cat_norm"),
        F.col("slot").cast("long").alias("slot"),
        F.col("rule").alias("_rule"),
        F.col("action").alias("_action"),
    )
    chosen = lookup_join(assigned_slots(kb, variants), texts, ["cat_norm", "slot"], "inner", ["doc_id"])
    # doc_id is unique on both sides, so this join has no hot keys
    joined = kb.join(chosen.select("doc_id", "_rule", "_action"), "doc_id", "left")
    return joined.withColumn("rule", F.coalesce("_rule", "rule")).withColumn(
        "action", F.coalesce("_action", "action")
    ).select(*kb.columns)


def unknown_categories(kb: DataFrame, variants: DataFrame) -> DataFrame:
    """Categories of ``variants`` that no row of ``kb`` has."""
    present = kb.select(category_key(F.col("category")).alias("cat_norm")).distinct()
    offered = variants.select("category", category_key(F.col("category")).alias("cat_norm")).distinct()
    return offered.join(present, "cat_norm", "left_anti").select("category")


def rules_per_category(kb: DataFrame) -> DataFrame:
    """Rows and distinct rules of every category; 128 bits stand for a rule in the shuffle."""
    rule = F.col("rule")
    key = [F.when(rule.isNotNull(), F.xxhash64(F.lit(1), rule)), F.when(rule.isNotNull(), F.xxhash64(rule, F.lit(2)))]
    return kb.groupBy("category").agg(F.count("*").alias("n_rows"), F.countDistinct(*key).alias("n_rules"))


def redundant_categories(kb: DataFrame) -> DataFrame:
    """Categories where several rows share a rule."""
    return rules_per_category(kb).filter(F.col("n_rows") != F.col("n_rules"))


def rewritten_rows(kb: DataFrame, variants: DataFrame) -> DataFrame:
    """``category, n_rows, n_variants``: for every category of ``variants`` the rows that get one of them, and how many there are.

    A category that no row has is reported with 0 rows. Categories go by their key; the name is the least spelling.
    """
    offered = variants.groupBy(category_key(F.col("category")).alias("cat_norm")).agg(F.min("category").alias("category"), F.count("*").alias("n_variants"))
    rows = kb.groupBy(category_key(F.col("category")).alias("cat_norm")).agg(F.count("*").alias("n_rows"))
    return offered.join(rows, "cat_norm", "left").select("category", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_variants")
