"""Text columns and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.catalog.registry import query, with_parts
from lodestone.catalog.views import (
    INDEX_COLS, KB_SQL, SENTENCES_SQL, USAGE_SQL, form_sql, kb, key_sql, questions, sentences, social_sql, table,
    usage, user_turns,
)
from lodestone.functions import scalars, text as T


@query("SELECT doc_id, " + form_sql("text") + " AS form FROM documents")
def search_normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.search_form(F.col("text")).alias("form"))


@query(f"SELECT conv_id, turn, {social_sql('text')} AS form FROM conversations WHERE role = 'user'")
def social_normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_turns(spark, sf_dir).select("conv_id", "turn", T.social_form(F.col("text")).alias("form"))


@query(f"SELECT conv_id, turn, {key_sql(chr(39) + '  ' + chr(39) + ' || text')} AS key FROM conversations")
def category_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.category_key(padded).alias("key"))


@query("SELECT doc_id, lang || ' ' || text || ' ' || source AS composed FROM documents")
def composed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb(spark, sf_dir).select("doc_id", T.compose(*[F.col(c) for c in INDEX_COLS]).alias("composed"))


@query(
    "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id,"
    f" list_filter(string_split({form_sql('text')}, ' '), lambda w: len(w) >= 2) AS t FROM documents)"
)
def index_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(
    "SELECT doc_id, len(g) AS n_terms, array_to_string(g, '|') AS terms FROM (SELECT doc_id, list_concat(t,"
    " list_transform(list_zip(t[1:len(t)-1], t[2:]), lambda x: x[1] || ' ' || x[2])) AS g FROM (SELECT doc_id,"
    f" regexp_extract_all({form_sql('text')}, '[a-z0-9]{{2,}}') AS t FROM documents))"
)
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    grams = toks.select("doc_id", T.ngrams(F.col("t")).alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("n_terms"), F.array_join("g", "|").alias("terms"))


@query(
    "SELECT item_id AS query_id, array_to_string(list_sort(list_distinct(list_filter(string_split("
    f"{form_sql('text')}, ' '), lambda w: len(w) > 3))), ' ') AS words FROM benchmark"
)
def long_query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = questions(spark, sf_dir).select("query_id", T.search_form(F.col("text")).alias("form"))
    return forms.select("query_id", F.array_join(F.sort_array(T.long_words(F.col("form"))), " ").alias("words"))


@query(with_parts("SELECT query_id, regexp_matches(text, '\\S') AS has_text FROM sentences", SENTENCES_SQL))
def blank_input_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("query_id", T.has_text(F.col("text")).alias("has_text"))


@query(
    "SELECT event_id, round(coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE value END, 0), 3) AS ms,"
    " CASE WHEN event_type = 'view' THEN 0 ELSE CAST(props ->> '$.k' AS BIGINT) END AS tokens FROM events"
)
def numbers_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    ms = F.when(kind == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    k = F.when(kind != "view", F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(scalars.number_or_zero(ms), 3).alias("ms"),
        scalars.count_or_zero(k).alias("tokens"),
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts FROM events")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    instant = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", scalars.iso_utc(instant).alias("ts"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE hour(ts) END AS hour FROM events")
def hours_of_text_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'-03:00'")
    bad = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy")).otherwise(F.concat(F.lit("at "), text))
    short = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    kind = F.col("event_type")
    broken = F.when(kind == "error", bad).when(kind == "signup", short).otherwise(text)
    hour = scalars.wall_clock_hour(broken).cast("long")
    return table(spark, sf_dir, "events").select("event_id", hour.alias("hour"))


@query(with_parts("SELECT event_id, coalesce(nullif(metodo, ''), 'nenhum') AS metodo FROM usage", USAGE_SQL))
def labels_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select("event_id", scalars.label_or(F.col("metodo"), "nenhum").alias("metodo"))


@query(
    with_parts(
        "SELECT doc_id, substr(replace(rule, chr(10), ' '), 1, 46) AS label, replace(action, 'en/', '') AS short_action"
        " FROM kb",
        KB_SQL,
    )
)
def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb(spark, sf_dir).select(
        "doc_id",
        T.short_label(F.col("rule"), 46).alias("label"),
        T.short_label(F.col("action"), 200, prefix="en/").alias("short_action"),
    )


@query(
    "SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda s: ltrim(s)),"
    " lambda s: s <> '' AND NOT starts_with(s, 'Th'))) AS n_lines FROM documents"
)
def counted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.code_lines(F.col("text"), comment="Th").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("n_lines"))
