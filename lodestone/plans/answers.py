"""Route a batch of messages, answer it, turn hits into prompts and log what happened."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.scalars import count_or_zero, iso_utc, number_or_zero
from lodestone.functions.text import has_text, search_form
from lodestone.operators.sizing import lookup_join, small_enough
from lodestone.plans.index import TextIndex
from lodestone.plans.intent import DEFAULT_LEXICON, GOODBYE, GREETING, THANKS, Lexicon, canned_reply, classify_intent
from lodestone.plans.search import KEYWORD, THRESHOLD, TOP_K, WordIndex, cascade_search, with_rows
from lodestone.session import cut_lineage

# Labels the log and the reports go by.
SOCIAL_METHOD = "cortesia"
NO_METHOD = "nenhum"
REQUEST = "api_consulta"
GENERATION = "llm"
FAILED = "generation_failed"

REPLIES = {
    GREETING: "Hello! Tell me what went wrong and I will look for the procedure.",
    THANKS: "You are welcome. Ask again whenever you need to.",
    GOODBYE: "Goodbye, and good luck.",
}
NO_KB = "The knowledge base is not loaded. Please tell whoever runs this service."
NO_FACTS = "- no matching procedure was found"
TEMPLATE = (
    "Answer only from the procedures below.\n\n"
    "Procedures (best {k}):\n{facts}\n\n"
    "Question: {question}\n"
)
HIT_COLUMNS = ("category", "rule", "action")


def nested_hits(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``query_id, method, top_score, hits``: at most k hits per query, in rank order."""
    entry = F.struct("rank", "doc_id", "similarity", *columns)
    return hits.groupBy("query_id").agg(
        F.max("method").alias("method"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top_score"),
        F.array_sort(F.collect_list(entry)).alias("hits"),
    )


def _searched(
    asked: DataFrame, index: TextIndex, words: WordIndex, kb: DataFrame, columns: Sequence[str], k: int, threshold: float
) -> DataFrame:
    """``query_id, method, top_score, n_hits, hits`` of every message. Messages of one normalised text are searched once.

    The rows of the hits are fetched last, and only if ``hits`` is read; until then a hit is its document's id.
    """
    formed = cut_lineage(asked.select("query_id", search_form(F.col("text")).alias("form")))
    once = cut_lineage(formed.groupBy("form").agg(F.min("query_id").alias("_first")))
    hits = cascade_search(index, words, once.select(F.col("_first").alias("query_id"), F.col("form").alias("text")), k, threshold)
    hits = cut_lineage(hits)
    found = nested_hits(with_rows(hits, kb, ()), ())
    found = found.select(F.col("query_id").alias("_first"), "method", "top_score", F.size("hits").alias("n_hits"))
    found = cut_lineage(once.join(found, "_first", "left"))
    answers = lookup_join(formed, found, ["form"], "left", ["query_id"]).drop("form")
    # a left join on a key of its own, so that Spark leaves it out where no hit is read
    ids = hits.select(*[c for c in hits.columns if c not in columns])
    rows = kb.select("doc_id", *columns).join(F.broadcast(ids), "doc_id") if small_enough(ids) else with_rows(ids, kb, columns)
    texts = rows.groupBy(F.col("query_id").alias("_first")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "similarity", *columns))).alias("hits"))
    return answers.join(texts, "_first", "left").drop("_first")


def answer_batch(
    messages: DataFrame,
    index: TextIndex | None,
    words: WordIndex | None,
    kb: DataFrame | None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    replies: Mapping[str, str] = REPLIES,
    columns: Sequence[str] = HIT_COLUMNS,
    k: int = TOP_K,
    threshold: float = THRESHOLD,
    no_kb: str = NO_KB,
) -> DataFrame:
    """``query_id, status, method, intent, reply, top_score, n_hits, hits`` per message.

    Blank messages get status ``empty_query``; social ones a canned reply; the rest is
    searched. With no index, the rest gets status ``kb_unavailable`` and the reply ``no_kb``.
    """
    routed = cut_lineage(classify_intent(messages.select("query_id", "text"), lexicon))
    blank = routed.filter(~has_text(F.col("text"))).select("query_id", F.lit("empty_query").alias("status"))
    social = routed.filter(F.col("intent").isNotNull()).select(
        "query_id",
        F.lit("ok").alias("status"),
        F.lit(SOCIAL_METHOD).alias("method"),
        "intent",
        canned_reply(F.col("intent"), dict(replies)).alias("reply"),
    )
    rest = routed.filter(F.col("intent").isNull() & has_text(F.col("text"))).select("query_id", "text")
    if index is None or words is None or kb is None:
        parts = rest.select(
            "query_id", F.lit("kb_unavailable").alias("status"), F.lit(NO_METHOD).alias("method"), F.lit(no_kb).alias("reply")
        )
    else:
        parts = _searched(rest, index, words, kb, columns, k, threshold).select(
            "query_id",
            F.lit("ok").alias("status"),
            F.coalesce("method", F.lit(KEYWORD)).alias("method"),
            "top_score",
            "n_hits",
            "hits",
        )
    answers = parts.unionByName(social, allowMissingColumns=True).unionByName(blank, allowMissingColumns=True)
    for name, kind in (("top_score", "double"), ("n_hits", "int"), ("hits", "array<string>")):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast(kind))
    return answers.select(
        "query_id",
        "status",
        "method",
        "intent",
        "reply",
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        "hits",
    )


def hit_view(hits: DataFrame, columns: Sequence[str] = HIT_COLUMNS) -> DataFrame:
    """The columns of a hit that a caller sees, with the ticket where the hits carry it."""
    ticket = [c for c in ("ticket_id",) if c in hits.columns and c not in columns]
    return hits.select("query_id", "rank", "similarity", *columns, *ticket, "doc_id")


def fact_line(category: Column, rule: Column, action: Column, similarity: Column) -> Column:
    """One hit as text; the score with two decimals only where there is one."""
    line = F.concat(
        F.lit("- category: "), category, F.lit(" | rule: "), rule, F.lit(" | action: "), action
    )
    scored = F.concat(line, F.format_string(" (score %.2f)", similarity))
    return F.when(similarity.isNotNull(), scored).otherwise(line)


def fact_texts(hits: DataFrame) -> DataFrame:
    """``query_id, facts``: the lines of one query's hits in rank order (at most k of them)."""
    line = fact_line(F.col("category"), F.col("rule"), F.col("action"), F.col("similarity"))
    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return grouped.select("query_id", F.array_join(F.col("l.line"), "\n").alias("facts"))


def nested_facts(hits: Column) -> Column:
    """The same text from one query's hits as :func:`answer_batch` holds them, in rank order; null without any."""
    lines = F.transform(hits, lambda h: fact_line(h["category"], h["rule"], h["action"], h["similarity"]))
    return F.when(F.size(hits) > 0, F.array_join(lines, "\n"))


def fill_template(template: str, **values: Column) -> Column:
    """Put columns into ``{name}`` places; their own text is never read as a template."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def build_prompts(queries: DataFrame, hits: DataFrame, template: str = TEMPLATE, k: int = TOP_K) -> DataFrame:
    """``query_id, prompt`` for every query; ``hits`` carries the hit columns."""
    return _prompts(queries.join(fact_texts(hits), "query_id", "left"), template, k)


def _prompts(filled: DataFrame, template: str, k: int) -> DataFrame:
    """The same from ``query_id, text, facts``."""
    prompt = fill_template(
        template, facts=F.coalesce("facts", F.lit(NO_FACTS)), question=F.col("text"), k=F.lit(k)
    )
    return filled.select("query_id", prompt.alias("prompt"))


GENERATED = (
    "query_id {id}, answer string, ok boolean, erro string, duracao_ms double, usage string"
)


def generate(prompts: DataFrame, fn: Callable[[str], tuple[str, str]]) -> DataFrame:
    """Run a caller's function over a prompt table: ``fn(prompt) -> (text, usage as JSON)``.

    A call that raises becomes a row with ``ok = false`` and the error type.
    """

    def one(prompt: str) -> tuple[str | None, bool, str, float, str | None]:
        start = time.perf_counter()
        try:
            text, usage = fn(prompt)
            ok, error = True, ""
        except Exception as problem:  # per-row failures are data here
            text, usage, ok, error = None, None, False, type(problem).__name__
        return text, ok, error, round((time.perf_counter() - start) * 1000, 3), usage

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = pd.DataFrame(
                [one(p) for p in frame["prompt"]], columns=["answer", "ok", "erro", "duracao_ms", "usage"]
            )
            rows.insert(0, "query_id", frame["query_id"].to_numpy())
            yield rows

    schema = GENERATED.format(id=prompts.schema["query_id"].dataType.simpleString())
    return prompts.select("query_id", "prompt").mapInPandas(batches, schema)


def with_replies(answers: DataFrame, generated: DataFrame) -> DataFrame:
    """Answers with the generated text as ``reply``, or status ``generation_failed`` and the error type in ``erro``.

    ``generated``: at most one row per query, from ``generate``. Answers without one stay as
    they are, with an empty ``erro``.
    """
    made = generated.select("query_id", F.col("answer").alias("_answer"), F.col("ok").alias("_ok"), F.col("erro").alias("_erro"))
    failed = F.col("_ok") == F.lit(False)
    joined = answers.drop("erro").join(made, "query_id", "left")
    return joined.withColumns(
        {
            "status": F.when(failed, F.lit(FAILED)).otherwise(F.col("status")),
            "reply": F.when(F.col("_ok"), F.col("_answer")).otherwise(F.col("reply")),
            "erro": F.when(failed, F.col("_erro")).otherwise(F.lit("")),
        }
    ).drop("_answer", "_ok", "_erro")


def reply_batch(
    messages: DataFrame, answers: DataFrame, fn: Callable[[str], tuple[str, str]], template: str = TEMPLATE, k: int = TOP_K
) -> DataFrame:
    """Answers of ``answer_batch`` with a generated reply for every message that was searched.

    The caller's function runs once per prompt: its results are kept before they are joined. Answers are read as they come
    from ``answer_batch``, which holds what it searched for; the rows of the hits are not stored again.
    """
    searched = answers.filter((F.col("status") == "ok") & F.col("intent").isNull())
    asked = messages.select("query_id", "text")
    if asked.groupBy("query_id").count().filter("count > 1").isEmpty():
        # rows with the texts of hits are wide, so the messages are sent to them where that can be done
        facts = searched.select("query_id", nested_facts(F.col("hits")).alias("facts"))
        prompts = _prompts(facts.join(F.broadcast(asked) if small_enough(asked) else asked, "query_id"), template, k)
    else:  # the hits of messages with one id make one prompt
        asked = asked.join(searched.select("query_id"), "query_id", "left_semi")
        prompts = build_prompts(asked, searched.select("query_id", F.inline("hits")), template, k)
    return with_replies(answers, cut_lineage(generate(prompts, fn)))


USAGE = "prompt_tokens long, completion_tokens long, total_tokens long, modelo string, model string"


def usage_fields(usage: Column) -> list[Column]:
    """Token counts and model name out of a JSON usage text; missing parts are 0 and ''."""
    parsed = F.from_json(usage, USAGE)
    counts = [
        count_or_zero(parsed[n]).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")
    ]
    return [*counts, F.coalesce(parsed["modelo"], parsed["model"], F.lit("")).alias("modelo")]


EVENT_COLUMNS = (
    "ts", "endpoint", "metodo", "modelo", "ok", "erro", "duracao_ms",
    "prompt_tokens", "completion_tokens", "total_tokens", "top_score",
)


def generation_events(results: DataFrame, ts: Column) -> DataFrame:
    """Log rows for generated answers."""
    return results.select(
        iso_utc(ts).alias("ts"),
        F.lit(GENERATION).alias("endpoint"),
        F.lit("").alias("metodo"),
        "ok",
        "erro",
        F.round(number_or_zero(F.col("duracao_ms")), 3).alias("duracao_ms"),
        F.lit(0.0).alias("top_score"),
        *usage_fields(F.col("usage")),
    ).select(*EVENT_COLUMNS)


def request_events(answers: DataFrame, ts: Column, duration_ms: Column) -> DataFrame:
    """Log rows for answered requests (blank messages are refused before the log)."""
    served = answers.filter(F.col("status") != "empty_query")
    ok = F.col("status") == "ok"
    zero = F.lit(0).cast("long")
    error = F.nullif(F.col("erro"), F.lit("")) if "erro" in answers.columns else F.lit(None).cast("string")
    return served.select(
        iso_utc(ts).alias("ts"),
        F.lit(REQUEST).alias("endpoint"),
        F.col("method").alias("metodo"),
        F.lit("").alias("modelo"),
        ok.alias("ok"),
        F.when(ok, F.lit("")).otherwise(F.coalesce(error, F.col("status"))).alias("erro"),
        F.round(number_or_zero(duration_ms), 3).alias("duracao_ms"),
        zero.alias("prompt_tokens"),
        zero.alias("completion_tokens"),
        zero.alias("total_tokens"),
        F.round(number_or_zero(F.col("top_score")), 4).alias("top_score"),
    )
