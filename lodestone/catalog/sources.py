"""Sources and sinks: what is written comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.catalog.registry import query, with_parts
from lodestone.catalog.views import (
    KB_SQL, USAGE_SQL, VARIANTS_SQL, form_sql, fresh_folder, kb, table, usage, variants,
)
from lodestone.functions.text import search_form
from lodestone.plans.rewrite import unknown_categories
from lodestone.plans.usage import method_mix, totals
from lodestone.sources.events import append_events, parse_events, read_events
from lodestone.sources.kb import KB_COLUMNS, PARITY_ENCODING, read_kb, write_kb
from lodestone.sources.reports import read_document, read_section, write_report


def _file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with all columns of the delimited file; the free text is theirs as it is."""
    rows = kb(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("T-"), "doc_id").alias("ticket_id"),
        F.col("description").alias("department"),
        F.col("category").alias("mood"),
        "category",
        F.col("rule").alias("description"),
        search_form(F.col("rule")).alias("rule"),
        "action",
    )
    return rows.select("doc_id", *KB_COLUMNS.values())


@query(
    with_parts(
        "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, 'T-' || doc_id AS ticket_id, description AS department,"
        " category AS mood, category, rule AS description,"
        f" nullif({form_sql('rule')}, '') AS rule, action FROM kb",
        KB_SQL,
    )
)
def kb_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "kb")
    write_kb(_file_rows(spark, sf_dir), path)
    return read_kb(spark, path)


@query(with_parts("SELECT DISTINCT category FROM variants", VARIANTS_SQL))
def categories_of_absent_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is not there is an empty table, so no category of the variants is known."""
    return unknown_categories(read_kb(spark, fresh_folder(spark, "absent")), variants(spark, sf_dir))


@query("SELECT 'T-' || doc_id AS ticket_id, strlen(text) AS n_chars FROM documents")
def kb_read_as_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read as one-byte characters, a UTF-8 text has as many characters as bytes."""
    path = fresh_folder(spark, "kb")
    write_kb(_file_rows(spark, sf_dir), path)
    rows = read_kb(spark, path, PARITY_ENCODING)
    return rows.select("ticket_id", F.char_length("description").cast("long").alias("n_chars"))


@query(
    "SELECT event_id, event_type AS metodo, event_type IN ('click', 'purchase') AS ok,"
    " CAST(props ->> '$.k' AS BIGINT) AS total_tokens FROM events WHERE event_type <> 'view'"
)
def tolerant_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of many shapes: plain, no ``ok``, ``ok`` null or empty, and (for views) cut off or with more after the object."""
    kind = F.col("event_type")
    ok = (
        F.when(kind == "click", F.lit("true"))
        .when(kind == "signup", F.get(F.array(F.lit("null"), F.lit("[]"), F.lit("{}")), (F.col("event_id") % 3).cast("int")))
        .when(kind == "error", F.lit("false"))
    )
    k = F.get_json_object("props", "$.k")
    tails = ["", "} junk", "}] junk", '}] {"a": 1}', '},{"a": 1}', '},{"a": 1}] junk']
    tail = F.get(F.array(*[F.lit(t) for t in tails]), (F.col("event_id") % len(tails)).cast("int"))
    line = F.concat(
        F.lit('{"metodo": "'), kind, F.lit('", "total_tokens": '), k,
        F.coalesce(F.concat(F.lit(', "ok": '), ok), F.lit("")),
        F.when(kind == "view", tail).otherwise(F.lit("}")),
    )
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    return parse_events(lines, "event_id").select("event_id", "metodo", "ok", "total_tokens")


@query(
    with_parts(
        "SELECT ts, endpoint, metodo, modelo, ok, erro, duracao_ms, prompt_tokens, completion_tokens, total_tokens,"
        " round(top_score, 4) AS top_score FROM usage",
        USAGE_SQL,
    )
)
def log_append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one log, read back as one."""
    path = fresh_folder(spark, "log")
    events = usage(spark, sf_dir).withColumn("top_score", F.round("top_score", 4))
    append_events(events.filter("ok"), path)
    append_events(events.filter("NOT ok"), path)
    return read_events(spark, path).drop("src_file", "src_block", "src_row")


@query(
    with_parts(
        "SELECT ts, endpoint, metodo, modelo, ok, erro, duracao_ms, prompt_tokens, completion_tokens, total_tokens,"
        " round(top_score, 4) AS top_score FROM usage",
        USAGE_SQL,
    )
)
def log_appends_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named batches appended to one log, one of them twice: it is there once."""
    path = fresh_folder(spark, "log")
    events = usage(spark, sf_dir).withColumn("top_score", F.round("top_score", 4))
    append_events(events.filter("ok"), path, "right")
    append_events(events.filter("NOT ok"), path, "wrong")
    append_events(events.filter("ok"), path, "right")
    return read_events(spark, path).drop("src_file", "src_block", "src_row")


@query(
    with_parts(
        "SELECT 'mix_de_metodos' AS section, coalesce(nullif(metodo, ''), 'nenhum') AS name, count(*) AS n FROM usage"
        " WHERE endpoint = 'api_consulta' GROUP BY 2"
        " UNION ALL SELECT 'llm_usage', 'n_eventos', count(*) FROM usage"
        " UNION ALL SELECT 'llm_usage', 'n_eventos_llm', count(*) FILTER (endpoint = 'llm') FROM usage"
        " UNION ALL SELECT 'llm_usage', 'n_eventos_api', count(*) FILTER (endpoint = 'api_consulta') FROM usage"
        " UNION ALL SELECT 'llm_usage', 'n_erros', count(*) FILTER (NOT ok) FROM usage"
        " UNION ALL SELECT 'llm_usage', 'total_tokens', CAST(sum(total_tokens) FILTER (endpoint = 'llm') AS BIGINT) FROM usage",
        USAGE_SQL,
    )
)
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sections of a report, written and read back."""
    path = fresh_folder(spark, "report")
    events = usage(spark, sf_dir)
    write_report({"llm_usage": totals(events), "mix_de_metodos": method_mix(events)}, path)
    mix = read_section(spark, path, "mix_de_metodos", "metodo string, n long")
    counts = ["n_eventos", "n_eventos_llm", "n_eventos_api", "n_erros", "total_tokens"]
    whole = read_section(spark, path, "llm_usage", ", ".join(f"{c} long" for c in counts))
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in counts]))
    return mix.select(F.lit("mix_de_metodos").alias("section"), F.col("metodo").alias("name"), "n").unionByName(
        whole.select(F.lit("llm_usage").alias("section"), pairs)
    )


@query(
    "SELECT conv_id, turn, p - 1 AS place, s[p] AS line FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS p"
    " FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations))"
)
def nested_document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per turn, read back as the rows of its list."""
    path = fresh_folder(spark, "documents")
    items = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(F.col("conv_id"), F.col("turn"), i.alias("place"), line.alias("line")),
    )
    turns = table(spark, sf_dir, "conversations").select(F.to_json(F.struct(items.alias("items"))).alias("value"))
    turns.write.text(path)
    schema = "conv_id long, turn long, place long, line string"
    return read_document(spark, path, "items", schema, multi_line=False)
