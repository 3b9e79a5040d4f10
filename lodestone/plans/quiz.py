"""Multiple-choice questions from the knowledge base, and their grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.scalars import draw, draw_below
from lodestone.operators.ordering import with_sequence
from lodestone.operators.sampling import sample_rows
from lodestone.operators.sizing import lookup_join
from lodestone.session import cut_lineage

OPTIONS = "ABC"


def numbered_actions(kb: DataFrame, seed: str) -> DataFrame:
    """``action, place``: the distinct actions in a drawn order, from 0."""
    distinct = kb.select("action").filter(F.col("action").isNotNull()).distinct()
    keyed = distinct.withColumn("_draw", draw(seed, F.col("action")))
    placed = with_sequence(keyed, ["_draw", "action"], "place")
    return placed.select("action", (F.col("place") - 1).alias("place"))


def wrong_places(own: Column, n_actions: int, seed: str, item: Column) -> list[Column]:
    """Two different places other than ``own``, drawn evenly.

    The first draw is over the n - 1 other places; the second over the n - 2 left, moved
    past the places already taken. No pair of item and action has to be formed.
    """
    first = draw_below(F.lit(n_actions - 1), f"{seed}/1", item)
    second = draw_below(F.lit(n_actions - 2), f"{seed}/2", item)
    second = F.when(second >= first, second + 1).otherwise(second)

    def past_own(place: Column) -> Column:
        return F.when(place >= own, place + 1).otherwise(place)

    return [past_own(first), past_own(second)]


def wrong_answers(items: DataFrame, kb: DataFrame, seed: str) -> DataFrame:
    """``item_id, draw, action``: two wrong actions per item, drawn without replacement."""
    actions = cut_lineage(numbered_actions(kb, seed))
    n = actions.count()
    if n < len(OPTIONS):
        raise ValueError(f"a question needs {len(OPTIONS)} distinct actions, the table has {n}")
    own = lookup_join(items.select("item_id", "action"), actions, ["action"], "inner", ["item_id"])
    places = wrong_places(F.col("place"), n, seed, F.col("item_id"))
    drawn = own.select("item_id", F.posexplode_outer(F.array(*places)).alias("draw", "place"))
    return lookup_join(drawn, actions, ["place"], "inner", ["item_id", "draw"]).select(
        "item_id", (F.col("draw") + 1).alias("draw"), "action"
    )


def make_quiz(kb: DataFrame, seed: str = "quiz", n: int | None = None) -> DataFrame:
    """``item_id, option_letter, action, is_correct``: three shuffled options per item.

    ``n`` draws that many rows as items; without it every row becomes one.
    """
    asked = kb.filter(F.col("action").isNotNull()).select(F.col("doc_id").alias("item_id"), "action")
    items = cut_lineage(sample_rows(asked, "item_id", n, seed)) if n is not None else asked
    right = items.select("item_id", "action", F.lit(True).alias("is_correct"))
    wrong = wrong_answers(items, kb, seed).select("item_id", "action", F.lit(False).alias("is_correct"))
    both = right.unionByName(wrong)
    # three rows per item
    option = F.struct(draw(f"{seed}/order", F.col("item_id"), F.col("action")).alias("d"), "action", "is_correct")
    sets = both.groupBy("item_id").agg(F.array_sort(F.collect_list(option)).alias("o"))
    return sets.select("item_id", F.posexplode_outer("o").alias("i", "e")).select(
        "item_id",
        F.substring(F.lit(OPTIONS), F.col("i") + 1, F.lit(1)).alias("option_letter"),
        F.col("e.action").alias("action"),
        F.col("e.is_correct").alias("is_correct"),
    )


def answer_key(quiz: DataFrame) -> DataFrame:
    return quiz.filter("is_correct").select("item_id", F.col("option_letter").alias("key"))


def grade(responses: DataFrame, quiz: DataFrame) -> DataFrame:
    """``responses`` (item_id, response, …) with the key and whether it was met."""
    salt_on = [c for c in responses.columns if c != "item_id"]
    graded = lookup_join(responses, cut_lineage(answer_key(quiz)), ["item_id"], "inner", salt_on)
    return graded.withColumn("correct", F.upper("response") == F.col("key"))
