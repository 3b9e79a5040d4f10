"""The usage report, in batch and kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.catalog.registry import query, with_parts
from lodestone.catalog.views import USAGE_SQL, fresh_folder, usage
from lodestone.functions.scalars import iso_utc
from lodestone.plans import usage as U
from lodestone.session import cut_lineage
from lodestone.sources.events import append_events, read_events
from lodestone.streaming.usage import merge_days, start_rollup

_REQUESTS_SQL = (
    USAGE_SQL + ",\nrequests AS (SELECT event_id, coalesce(nullif(metodo, ''), 'nenhum') AS metodo, duracao_ms,"
    " top_score FROM usage WHERE endpoint = 'api_consulta')"
)


def _totals_sql(source: str) -> str:
    return (
        "SELECT count(*) FILTER (endpoint = 'llm') > 0 AS disponivel, count(*) AS n_eventos,"
        " count(*) FILTER (endpoint = 'llm') AS n_eventos_llm,"
        " count(*) FILTER (endpoint = 'api_consulta') AS n_eventos_api, count(*) FILTER (NOT ok) AS n_erros,"
        " CAST(coalesce(sum(total_tokens) FILTER (endpoint = 'llm'), 0) AS BIGINT) AS total_tokens,"
        " CAST(coalesce(sum(prompt_tokens) FILTER (endpoint = 'llm'), 0) AS BIGINT) AS prompt_tokens_total,"
        " CAST(coalesce(sum(completion_tokens) FILTER (endpoint = 'llm'), 0) AS BIGINT) AS completion_tokens_total"
        f" FROM {source}"
    )


@query(with_parts(_totals_sql("usage"), USAGE_SQL))
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.totals(usage(spark, sf_dir))


@query(with_parts(_totals_sql("(SELECT * FROM usage WHERE duracao_ms < 0)"), USAGE_SQL))
def usage_totals_of_empty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.totals(usage(spark, sf_dir).filter(F.col("duracao_ms") < 0))


@query(with_parts("SELECT modelo, count(*) AS n FROM usage WHERE endpoint = 'llm' AND modelo <> '' GROUP BY modelo", USAGE_SQL))
def calls_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.calls_per_model(usage(spark, sf_dir))


@query(
    "SELECT CAST(h.hour AS INTEGER) AS hour, count(event_id) AS n FROM (SELECT unnest(range(24)) AS hour) h"
    " LEFT JOIN events ON hour(ts) = h.hour GROUP BY h.hour"
)
def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.events_per_hour(usage(spark, sf_dir))


@query(
    with_parts(
        "SELECT 'llm_usage' AS section, 'n_eventos' AS name, count(*) AS n FROM usage"
        " UNION ALL SELECT 'llm_usage', 'n_erros', count(*) FILTER (NOT ok) FROM usage"
        " UNION ALL SELECT 'llm_usage', 'total_tokens', CAST(sum(total_tokens) FILTER (endpoint = 'llm') AS BIGINT) FROM usage"
        " UNION ALL SELECT 'modelos', modelo, count(*) FROM usage WHERE endpoint = 'llm' AND modelo <> '' GROUP BY modelo"
        " UNION ALL SELECT 'horas', CAST(h.hour AS VARCHAR), count(event_id) FROM (SELECT unnest(range(24)) AS hour) h"
        " LEFT JOIN events ON hour(events.ts) = h.hour GROUP BY h.hour"
        " UNION ALL SELECT 'mix_de_metodos', coalesce(nullif(metodo, ''), 'nenhum'), count(*) FROM usage WHERE endpoint = 'api_consulta' GROUP BY 2",
        USAGE_SQL,
    )
)
def report_counts_of_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of the report that count, from cells that were counted in one pass over the log."""
    found = U.count_sections(cut_lineage(U.count_cells(usage(spark, sf_dir))))
    totals = ("n_eventos", "n_erros", "total_tokens")
    rows = found["llm_usage"].select(F.lit("llm_usage").alias("section"), F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in totals])))
    for section, name in (("modelos", "modelo"), ("horas", "hour"), ("mix_de_metodos", "metodo")):
        rows = rows.unionByName(found[section].select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), "n"))
    return rows


@query(
    with_parts(
        "SELECT row_number() OVER (ORDER BY ts, event_id) AS chamada, prompt_tokens AS prompt,"
        " completion_tokens AS completion FROM usage WHERE endpoint = 'llm' AND ok",
        USAGE_SQL,
    )
)
def tokens_per_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tokens_per_call(usage(spark, sf_dir))


@query(
    with_parts(
        "SELECT metodo, count(*) AS n, round(quantile_cont(duracao_ms, 0.5), 3) AS p50,"
        " round(quantile_cont(duracao_ms, 0.95), 3) AS p95, round(max(duracao_ms), 3) AS max"
        " FROM requests GROUP BY metodo",
        _REQUESTS_SQL,
    )
)
def latency_per_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.latency_per_method(usage(spark, sf_dir))


@query(with_parts("SELECT metodo, count(*) AS n FROM requests GROUP BY metodo", _REQUESTS_SQL))
def method_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.method_mix(usage(spark, sf_dir))


@query(with_parts("SELECT event_id, round(top_score, 4) AS top_score FROM requests WHERE top_score > 0", _REQUESTS_SQL))
def request_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.top_scores(usage(spark, sf_dir))


_ROLLUP_SQL = with_parts(
    "SELECT strftime(date_trunc('hour', ts_raw), '%Y-%m-%dT%H:%M:%S.%gZ') AS hour_start, coalesce(nullif(metodo, ''), 'nenhum') AS metodo, count(*) AS n,"
    " count(*) FILTER (NOT ok) AS n_erros, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,"
    " round(sum(duracao_ms), 2) AS ms_sum, max(duracao_ms) AS ms_max, round(avg(top_score), 5) AS score_avg"
    " FROM usage GROUP BY 1, 2",
    USAGE_SQL,
)


def _rounded(rollup: DataFrame) -> DataFrame:
    return rollup.drop("hour_end").withColumns(
        {
            "hour_start": iso_utc(F.col("hour_start")),
            "ms_sum": F.round("ms_sum", 2),
            "score_avg": F.round("score_avg", 5),
        }
    )


@query(_ROLLUP_SQL)
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(U.hourly_rollup(usage(spark, sf_dir)))


@query(_ROLLUP_SQL)
def continuous_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as JSON lines, then rolled up by a stream into a merged table."""
    log, state, table = (fresh_folder(spark, p) for p in ("log", "state", "rollup"))
    append_events(usage(spark, sf_dir), log)

    start_rollup(spark, log, state, lambda batch, _: merge_days(batch, table)).awaitTermination()
    return _rounded(spark.read.parquet(table).drop("day"))


@query(with_parts(_totals_sql("usage"), USAGE_SQL))
def usage_totals_beside_absent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is not there adds no events."""
    absent = read_events(spark, fresh_folder(spark, "absent")).drop("src_file", "src_block", "src_row")
    return U.totals(usage(spark, sf_dir).select(*absent.columns).unionByName(absent))
