"""Usage report over the event log: one DataFrame per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.scalars import count_or_zero, event_time, label_or, number_or_zero, wall_clock_hour
from lodestone.operators.ordering import with_sequence
from lodestone.operators.quantiles import exact_percentiles
from lodestone.operators.shares import dense_axis
from lodestone.plans.answers import GENERATION, NO_METHOD, REQUEST
from lodestone.session import cut_lineage

LATENCY_POINTS = {"p50": 0.50, "p95": 0.95}


def _is_llm() -> Column:
    return F.col("endpoint") == GENERATION


def _requests(events: DataFrame) -> DataFrame:
    return events.filter(F.col("endpoint") == REQUEST).withColumn("metodo", label_or(F.col("metodo"), NO_METHOD))


def totals(events: DataFrame) -> DataFrame:
    """Counts and token sums in one pass; a single row of zeros for an empty log."""

    def tokens(column: str) -> Column:
        return F.coalesce(F.sum(F.when(_is_llm(), count_or_zero(F.col(column)))), F.lit(0).cast("long"))

    return events.agg(
        F.count("*").alias("n_eventos"),
        F.count_if(_is_llm()).alias("n_eventos_llm"),
        F.count_if(F.col("endpoint") == REQUEST).alias("n_eventos_api"),
        F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("n_erros"),
        tokens("total_tokens").alias("total_tokens"),
        tokens("prompt_tokens").alias("prompt_tokens_total"),
        tokens("completion_tokens").alias("completion_tokens_total"),
    ).select((F.col("n_eventos_llm") > 0).alias("disponivel"), "*")


def calls_per_model(events: DataFrame) -> DataFrame:
    named = events.filter(_is_llm() & (F.coalesce(F.col("modelo"), F.lit("")) != ""))
    return named.groupBy("modelo").agg(F.count("*").alias("n"))


def events_per_hour(events: DataFrame) -> DataFrame:
    """All 24 hours; the hour is the one written in ``ts``, and bad times are not counted."""
    hours = events.select(wall_clock_hour(F.col("ts")).alias("hour")).filter(F.col("hour").isNotNull())
    return dense_axis(hours.groupBy("hour").agg(F.count("*").alias("n")), "hour", 24)


def tokens_per_call(events: DataFrame, order_by: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Successful generation calls, numbered in log order."""
    calls = events.filter(_is_llm() & F.col("ok")).select(
        *order_by,
        count_or_zero(F.col("prompt_tokens")).alias("prompt"),
        count_or_zero(F.col("completion_tokens")).alias("completion"),
    )
    return with_sequence(calls, order_by, "chamada").select("chamada", "prompt", "completion")


def latency_per_method(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Exact p50 and p95, maximum and count of the duration of requests."""
    timed = _requests(events).select("metodo", number_or_zero(F.col("duracao_ms")).alias("ms"))
    found = exact_percentiles(timed, "ms", LATENCY_POINTS, ["metodo"], slices)
    return found.select("metodo", "n", *[F.round(c, 3).alias(c) for c in (*LATENCY_POINTS, "max")])


def method_mix(events: DataFrame) -> DataFrame:
    return _requests(events).groupBy("metodo").agg(F.count("*").alias("n"))


def top_scores(events: DataFrame) -> DataFrame:
    """Best scores of the requests that had one, as rows."""
    score = number_or_zero(F.col("top_score"))
    return _requests(events).filter(score > 0).select("event_id", F.round(score, 4).alias("top_score"))


def hourly_rollup(events: DataFrame) -> DataFrame:
    """Per hour of time and method: what the continuous roll-up keeps up to date."""
    return rollup_of(events.withColumn("at", event_time(F.col("ts"))))


def rollup_of(timed: DataFrame) -> DataFrame:
    """The grouped aggregation over a column ``at``; also used on a stream."""
    method = label_or(F.col("metodo"), NO_METHOD)
    grouped = timed.groupBy(F.window("at", "1 hour").alias("w"), method.alias("metodo")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.coalesce(F.col("ok"), F.lit(False)), 0).otherwise(1)).alias("n_erros"),
        F.sum(count_or_zero(F.col("total_tokens"))).alias("total_tokens"),
        F.sum(number_or_zero(F.col("duracao_ms"))).alias("ms_sum"),
        F.max(number_or_zero(F.col("duracao_ms"))).alias("ms_max"),
        F.avg(number_or_zero(F.col("top_score"))).alias("score_avg"),
    )
    rest = [c for c in grouped.columns if c != "w"]
    return grouped.select(F.col("w.start").alias("hour_start"), F.col("w.end").alias("hour_end"), *rest)


def count_cells(events: DataFrame) -> DataFrame:
    """The log counted once, by all that the count sections go by: ``endpoint, metodo, modelo, hour, n`` and sums.

    There are as many cells as combinations that occur, so each section is a small sum over them.
    """

    def tokens(column: str) -> Column:
        return F.sum(count_or_zero(F.col(column))).alias(column)

    keys = [
        "endpoint",
        label_or(F.col("metodo"), NO_METHOD).alias("metodo"),
        F.coalesce("modelo", F.lit("")).alias("modelo"),
        wall_clock_hour(F.col("ts")).alias("hour"),
    ]
    wrong = F.count_if(~F.coalesce(F.col("ok"), F.lit(False)))
    sums = [tokens(c) for c in ("total_tokens", "prompt_tokens", "completion_tokens")]
    return events.groupBy(*keys).agg(F.count("*").alias("n"), wrong.alias("n_erros"), *sums)


def count_sections(cells: DataFrame) -> dict[str, DataFrame]:
    """The sections of ``totals``, ``calls_per_model``, ``events_per_hour`` and ``method_mix``, out of ``count_cells``."""

    def whole(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0).cast("long"))

    llm, api = _is_llm(), F.col("endpoint") == REQUEST
    usage = cells.agg(
        whole(F.col("n")).alias("n_eventos"),
        whole(F.when(llm, F.col("n"))).alias("n_eventos_llm"),
        whole(F.when(api, F.col("n"))).alias("n_eventos_api"),
        whole(F.col("n_erros")).alias("n_erros"),
        whole(F.when(llm, F.col("total_tokens"))).alias("total_tokens"),
        whole(F.when(llm, F.col("prompt_tokens"))).alias("prompt_tokens_total"),
        whole(F.when(llm, F.col("completion_tokens"))).alias("completion_tokens_total"),
    )
    hours = cells.filter(F.col("hour").isNotNull()).groupBy("hour").agg(F.sum("n").alias("n"))
    return {
        "llm_usage": usage.select((F.col("n_eventos_llm") > 0).alias("disponivel"), "*"),
        "modelos": cells.filter(llm & (F.col("modelo") != "")).groupBy("modelo").agg(F.sum("n").alias("n")),
        "horas": dense_axis(hours, "hour", 24),
        "mix_de_metodos": cells.filter(api).groupBy("metodo").agg(F.sum("n").alias("n")),
    }


def usage_report(events: DataFrame, order_by: tuple[str, ...] = ("ts", "event_id")) -> dict[str, DataFrame]:
    """All sections; empty ones for an empty log. The log is read once for all sections that count."""
    return {
        **count_sections(cut_lineage(count_cells(events))),
        "tokens_por_chamada": tokens_per_call(events, order_by),
        "latencia_por_metodo": latency_per_method(events),
        "top_scores": top_scores(events),
    }
