"""Profiles, shares, evaluation, the rewrite of the knowledge base, and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.catalog.registry import query, with_parts
from lodestone.catalog.views import (
    KB_SQL, PAIRS_SQL, USAGE_SQL, VARIANTS_SQL, index_of, index_sql, kb, key_sql, table, usage, variants, vectors_sql,
)
from lodestone.operators import shares
from lodestone.operators.sampling import sample_rows
from lodestone.plans import evaluate as E, profile as P, quiz as Q, rewrite as R
from lodestone.plans.search import semantic_search

# --- profile ---------------------------------------------------------------------------


@query(
    with_parts(
        "SELECT category, count(*) AS n, CAST(grouping(category) AS INTEGER) AS is_total FROM kb GROUP BY ROLLUP (category)",
        KB_SQL,
    )
)
def category_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.category_balance(kb(spark, sf_dir))


@query(with_parts("SELECT action, count(*) AS n FROM kb GROUP BY action ORDER BY n DESC, action", KB_SQL))
def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.value_counts(kb(spark, sf_dir), "action").orderBy(F.desc("n"), "action")


@query(
    with_parts(
        "SELECT category, count(*) AS n_rows, count(DISTINCT rule) AS n_rules FROM kb GROUP BY category"
        " HAVING count(*) <> count(DISTINCT rule)",
        KB_SQL,
    )
)
def redundant_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.redundant_categories(kb(spark, sf_dir))


@query(with_parts("SELECT category, count(*) AS n_rows, count(DISTINCT rule) AS n_rules FROM kb GROUP BY category", KB_SQL))
def rules_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rules_per_category(kb(spark, sf_dir))


@query(
    "SELECT 'event_id' AS column_name, count(*) FILTER (event_id IS NULL) AS n_null FROM events"
    " UNION ALL SELECT 'price', count(*) FILTER (event_type = 'error') FROM events"
    " UNION ALL SELECT 'props', count(*) FILTER (props IS NULL) FROM events"
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("price", F.expr("nullif(event_type, 'error')"))
    return P.null_counts(events, ["event_id", "price", "props"])


@query(
    "SELECT count(*) AS n, round(avg(len(text)), 6) AS mean, round(stddev_samp(len(text)), 6) AS sd,"
    " min(len(text)) AS min, quantile_cont(len(text), 0.25) AS q25, quantile_cont(len(text), 0.5) AS q50,"
    " quantile_cont(len(text), 0.75) AS q75, max(len(text)) AS max FROM documents"
)
def text_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.length_summary(table(spark, sf_dir, "documents"), "text")


_COUNTS_SQL = KB_SQL + ",\ncounts AS (SELECT category, count(*) AS n FROM kb GROUP BY category)"


@query(with_parts("SELECT category, n, round(n / sum(n) OVER (), 6) AS share FROM counts", _COUNTS_SQL))
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.share_of_total(shares.value_counts(kb(spark, sf_dir), "category"), "n")


@query(with_parts("SELECT category, n, round(n / max(n) OVER (), 6) AS scale FROM counts", _COUNTS_SQL))
def category_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.share_of_max(shares.value_counts(kb(spark, sf_dir), "category"), "n")


@query(
    "SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + (b.bin + 0.5) * ((hi - lo) / 7), 4) AS mid, count(v.bin) AS n"
    " FROM (SELECT unnest(range(7)) AS bin) b CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events)"
    " LEFT JOIN (SELECT least(greatest(CAST(trunc((value - (SELECT min(value) FROM events))"
    " / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 7) AS INTEGER), 0), 6) AS bin"
    " FROM events) v ON v.bin = b.bin GROUP BY b.bin, lo, hi"
)
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.histogram(table(spark, sf_dir, "events"), "value", 7)


@query(
    with_parts(
        "SELECT count(*) AS n, count(*) FILTER (ok) AS n_passed, round(sum(duracao_ms), 1) AS total_ms,"
        " count(DISTINCT metodo) AS n_classes FROM usage",
        USAGE_SQL,
    )
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = usage(spark, sf_dir).select("ok", F.col("duracao_ms").alias("ms"), F.col("metodo").alias("class"))
    return E.run_summary(results)


@query("SELECT event_type AS class, count(*) AS n FROM events GROUP BY event_type")
def results_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.value_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "class"), "class")


# --- evaluation: labelled documents as queries against the benchmark passages -----------

_JUDGED_SQL = ",\n".join(
    [
        "kb AS (SELECT item_id AS doc_id, text, md5(text) AS dedup_key FROM benchmark)",
        "gold AS (SELECT doc_id AS query_id, quality = 1 AS relevant FROM labels)",
        "questions AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
        index_sql(text="text"),
        vectors_sql(),
        PAIRS_SQL,
        "judged AS (SELECT query_id, relevant, coalesce(max(score) FILTER (score > 0.05), -1) >= 0.10 AS predicted"
        " FROM gold LEFT JOIN pairs USING (query_id) GROUP BY ALL)",
    ]
)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    gold = labels.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("relevant"))
    asked = (
        table(spark, sf_dir, "documents")
        .join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("query_id"), "text")
    )
    return E.judged(semantic_search(index_of(spark, sf_dir, "passages"), asked), gold)


@query(with_parts("SELECT * FROM judged", _JUDGED_SQL))
def judged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


@query(
    with_parts(
        "SELECT TP, FP, TN, FN, round(p, 3) AS precision, round(r, 3) AS recall,"
        " round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM (SELECT *,"
        " CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0 END AS p,"
        " CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0 END AS r FROM cells)",
        _JUDGED_SQL,
        "cells AS (SELECT count(*) FILTER (relevant AND predicted) AS TP,"
        " count(*) FILTER (NOT relevant AND predicted) AS FP,"
        " count(*) FILTER (NOT relevant AND NOT predicted) AS TN,"
        " count(*) FILTER (relevant AND NOT predicted) AS FN FROM judged)",
    )
)
def retrieval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_judged(spark, sf_dir))


@query(
    "SELECT CAST(sum(CAST(quality = 1 AND toxic = 1 AS INTEGER)) AS BIGINT) AS TP,"
    " count(*) FILTER (quality <> 1 AND toxic = 1) AS FP, count(*) FILTER (quality <> 1 AND toxic <> 1) AS TN,"
    " count(*) FILTER (quality = 1 AND toxic <> 1) AS FN FROM labels"
)
def label_confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        (F.col("quality") == 1).alias("relevant"), (F.col("toxic") == 1).alias("predicted")
    )
    return E.confusion(rows).select("TP", "FP", "TN", "FN")


# --- rewrite ---------------------------------------------------------------------------

_SLOTS_SQL = ",\n".join(
    [
        KB_SQL,
        VARIANTS_SQL,
        f"sizes AS (SELECT {key_sql('category')} AS cat_norm, count(*) AS m FROM variants GROUP BY 1)",
        f"turns AS (SELECT doc_id, {key_sql('category')} AS cat_norm,"
        f" row_number() OVER (PARTITION BY {key_sql('category')} ORDER BY doc_id) - 1 AS turn FROM kb)",
        "slots AS (SELECT doc_id, cat_norm, turn % m AS slot FROM turns JOIN sizes USING (cat_norm))",
    ]
)


@query(with_parts("SELECT doc_id, cat_norm, slot FROM slots", _SLOTS_SQL))
def variant_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assigned_slots(kb(spark, sf_dir), variants(spark, sf_dir))


@query(
    with_parts(
        "SELECT kb.doc_id, kb.category, coalesce(v.rule, kb.rule) AS rule, kb.description,"
        " coalesce(v.action, kb.action) AS action FROM kb LEFT JOIN slots ON kb.doc_id = slots.doc_id"
        f" LEFT JOIN variants v ON {key_sql('v.category')} = slots.cat_norm AND v.slot = slots.slot",
        _SLOTS_SQL,
    )
)
def rewritten_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rewrite_kb(kb(spark, sf_dir), variants(spark, sf_dir))


@query(
    with_parts(
        f"SELECT DISTINCT category FROM variants WHERE {key_sql('category')} NOT IN (SELECT {key_sql('category')} FROM kb)",
        KB_SQL,
        VARIANTS_SQL,
    )
)
def unknown_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unknown_categories(kb(spark, sf_dir), variants(spark, sf_dir))


# --- quiz ------------------------------------------------------------------------------


def _draw_sql(seed: str, item: str, limit: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {item}), 1, 15) AS BIGINT) % ({limit})"


_QUIZ_SQL = ",\n".join(
    [
        KB_SQL,
        "actions AS (SELECT action, row_number() OVER (ORDER BY md5('quiz|' || action), action) - 1 AS place"
        " FROM (SELECT DISTINCT action FROM kb))",
        "total AS (SELECT count(*) AS m FROM actions)",
        "draws AS (SELECT doc_id AS item_id, action, place AS own,"
        f" {_draw_sql('quiz/1', 'doc_id', 'm - 1')} AS d1, {_draw_sql('quiz/2', 'doc_id', 'm - 2')} AS d2"
        " FROM kb JOIN actions USING (action) CROSS JOIN total)",
        "apart AS (SELECT item_id, action, own, d1, CASE WHEN d2 >= d1 THEN d2 + 1 ELSE d2 END AS d2 FROM draws)",
        "places AS (SELECT item_id, 1 AS draw, CASE WHEN d1 >= own THEN d1 + 1 ELSE d1 END AS place FROM apart"
        " UNION ALL SELECT item_id, 2, CASE WHEN d2 >= own THEN d2 + 1 ELSE d2 END FROM apart)",
        "wrong AS (SELECT item_id, draw, action FROM places JOIN actions USING (place))",
        "options AS (SELECT item_id, action, is_correct, substr('ABC', row_number() OVER (PARTITION BY item_id"
        " ORDER BY md5('quiz/order|' || item_id || '|' || action), action), 1) AS option_letter FROM ("
        "SELECT doc_id AS item_id, action, true AS is_correct FROM kb"
        " UNION ALL SELECT item_id, action, false FROM wrong))",
    ]
)


@query(with_parts("SELECT DISTINCT action FROM kb", KB_SQL))
def distinct_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb(spark, sf_dir).select("action").distinct()


@query(with_parts("SELECT item_id, CAST(draw AS INTEGER) AS draw, action FROM wrong", _QUIZ_SQL))
def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = kb(spark, sf_dir)
    return Q.wrong_answers(base.select(F.col("doc_id").alias("item_id"), "action"), base, "quiz")


@query(with_parts("SELECT item_id, option_letter, action, is_correct FROM options", _QUIZ_SQL))
def quiz_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.make_quiz(kb(spark, sf_dir))


@query(
    with_parts(
        "SELECT event_id, item_id, response, option_letter AS key, upper(response) = option_letter AS correct FROM"
        " (SELECT event_id, user_id AS item_id, substr('abc', CAST(event_id % 3 + 1 AS BIGINT), 1) AS response FROM events)"
        " JOIN options USING (item_id) WHERE is_correct",
        _QUIZ_SQL,
    )
)
def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers: a user's id is the item, the event id decides the letter."""
    letter = F.substring(F.lit("abc"), F.pmod("event_id", F.lit(3)).cast("int") + 1, F.lit(1))
    responses = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("item_id"), letter.alias("response")
    )
    return Q.grade(responses, Q.make_quiz(kb(spark, sf_dir)))


@query(with_parts("SELECT doc_id, rule FROM kb ORDER BY md5('sample|' || doc_id), doc_id LIMIT 25", KB_SQL))
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(kb(spark, sf_dir).select("doc_id", "rule"), "doc_id", 25, "sample")
