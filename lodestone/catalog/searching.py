"""Search: scores, top-k, keyword fallback, cascade, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.catalog.registry import query, with_parts
from lodestone.catalog.views import (
    KB_SQL, QUESTIONS_SQL, SEARCH_SQL, index_of, kb, questions, words_of, words_sql,
)
from lodestone.functions.text import score_label
from lodestone.operators.shares import histogram
from lodestone.plans import answers as A, search as S
from lodestone.plans.evaluate import score_points
from lodestone.session import cut_lineage


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.semantic_search(index_of(spark, sf_dir), questions(spark, sf_dir))


def _cascade(spark: SparkSession, sf_dir: str, threshold: float = S.THRESHOLD) -> DataFrame:
    return S.cascade_search(index_of(spark, sf_dir), words_of(spark, sf_dir), questions(spark, sf_dir), threshold=threshold)


def _full_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_rows(_cascade(spark, sf_dir), kb(spark, sf_dir), A.HIT_COLUMNS)


def _best_sql(source: str, columns: str) -> str:
    """The ten best rows of each query."""
    order = "PARTITION BY query_id ORDER BY score DESC, doc_id DESC"
    return f"SELECT {columns} FROM {source} WHERE score > 0.05 QUALIFY row_number() OVER ({order}) <= 10"


@query(with_parts(_best_sql("pairs", "query_id, doc_id, round(score, 4) AS cosine"), SEARCH_SQL))
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.best_documents(index_of(spark, sf_dir), questions(spark, sf_dir), 10)
    return best.select("query_id", "doc_id", F.round("score", 4).alias("cosine"))


@query(with_parts("SELECT query_id, count(*) AS n_docs FROM pairs WHERE score > 0.05 GROUP BY query_id", SEARCH_SQL))
def documents_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    pairs = S.score_pairs(index, S.asked_terms(index, questions(spark, sf_dir)))
    counts = pairs.filter(F.col("score") > S.THRESHOLD).groupBy("query_id").agg(F.count("*").alias("n_docs"))
    return cut_lineage(counts, by_block=True)


@query(with_parts(_best_sql("best", "query_id, dedup_key, doc_id, round(score, 4) AS cosine"), SEARCH_SQL))
def best_document_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.semantic_search(index_of(spark, sf_dir), questions(spark, sf_dir), 10)
    return best.select("query_id", "dedup_key", "doc_id", F.round("similarity", 4).alias("cosine"))


@query(with_parts("SELECT query_id, rank, doc_id, dedup_key, round(similarity, 4) AS similarity FROM hits", SEARCH_SQL))
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", "rank", "doc_id", "dedup_key", F.round("similarity", 4).alias("similarity"))


@query(
    with_parts(
        "SELECT query_id, rank, hits.doc_id, round(similarity, 4) AS similarity, category, rule, action"
        " FROM hits JOIN kb ON hits.doc_id = kb.doc_id",
        SEARCH_SQL,
    )
)
def hits_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = A.hit_view(S.with_rows(_hits(spark, sf_dir), kb(spark, sf_dir), A.HIT_COLUMNS))
    return full.withColumn("similarity", F.round("similarity", 4))


@query(
    with_parts(
        "SELECT query_id, doc_id FROM word_hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 500",
        KB_SQL, QUESTIONS_SQL, words_sql(),
    )
)
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows that hold a word of the query, copies included."""
    hits = S.keyword_search(words_of(spark, sf_dir), questions(spark, sf_dir), 500, copies=True)
    return hits.select("query_id", "doc_id")


@query(with_parts("SELECT query_id, rank, doc_id, dedup_key FROM word_top", KB_SQL, QUESTIONS_SQL, words_sql()))
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = S.keyword_search(words_of(spark, sf_dir), questions(spark, sf_dir))
    return hits.drop("similarity")


# A threshold that some of the queries miss, so that both branches of the cascade answer.
_STRICT = 0.35
_STRICT_SQL = SEARCH_SQL.replace("score > 0.05", f"score > {_STRICT}") + (
    ",\nrest AS (SELECT * FROM questions WHERE query_id NOT IN (SELECT query_id FROM hits)),\n"
    + words_sql("rest")
    + ",\ncascade AS (SELECT query_id, rank, doc_id, dedup_key, similarity, 'semantica' AS method FROM hits"
    " UNION ALL SELECT query_id, rank, doc_id, dedup_key, NULL, 'palavra_chave' FROM word_top)"
)


@query(with_parts("SELECT query_id FROM rest", _STRICT_SQL))
def queries_without_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    hits = S.semantic_search(index_of(spark, sf_dir), asked, threshold=_STRICT)
    return S.without_hits(asked, hits).select("query_id")


@query(with_parts("SELECT query_id, rank, doc_id, round(similarity, 4) AS similarity, method FROM cascade", _STRICT_SQL))
def cascade_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, _STRICT).select("query_id", "rank", "doc_id", F.round("similarity", 4).alias("similarity"), "method")


@query(
    with_parts(
        "SELECT query_id, coalesce(max(method), 'palavra_chave') AS method, count(doc_id) AS n_hits,"
        " coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank), '') AS doc_ids"
        " FROM questions LEFT JOIN cascade USING (query_id) GROUP BY query_id",
        _STRICT_SQL,
    )
)
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = S.search_answers(questions(spark, sf_dir), _cascade(spark, sf_dir, _STRICT))
    ids = F.array_join(F.col("hits.doc_id").cast("array<string>"), ",")
    return answers.select("query_id", "method", "n_hits", F.coalesce(ids, F.lit("")).alias("doc_ids"))


@query(
    with_parts(
        "SELECT query_id, rank, coalesce(printf('%.3f', similarity), 'fallback') AS label FROM cascade",
        _STRICT_SQL,
    )
)
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = score_label(F.col("similarity")).alias("label")
    return _cascade(spark, sf_dir, _STRICT).select("query_id", "rank", label)


_FACTS_SQL = (
    "facts AS (SELECT query_id, string_agg('- category: ' || category || ' | rule: ' || rule || ' | action: ' || action"
    " || printf(' (score %.2f)', similarity), chr(10) ORDER BY rank) AS facts"
    " FROM hits JOIN kb ON hits.doc_id = kb.doc_id GROUP BY query_id)"
)


@query(with_parts("SELECT query_id, facts FROM facts", SEARCH_SQL, _FACTS_SQL))
def fact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fact_texts(_full_hits(spark, sf_dir))


_PROMPT_SQL = (
    "SELECT query_id, 'Answer only from the procedures below.' || chr(10) || chr(10) || 'Procedures (best 3):'"
    " || chr(10) || coalesce(facts, '- no matching procedure was found') || chr(10) || chr(10) || 'Question: '"
    " || text || chr(10) AS prompt FROM questions LEFT JOIN facts USING (query_id)"
)


@query(with_parts(_PROMPT_SQL, SEARCH_SQL, _FACTS_SQL))
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.build_prompts(questions(spark, sf_dir), _full_hits(spark, sf_dir))


@query(
    with_parts(
        "SELECT query_id, CASE WHEN len(text) % 2 = 0 THEN 'echo: ' || text END AS answer, len(text) % 2 = 0 AS ok,"
        " CASE WHEN len(text) % 2 = 0 THEN '' ELSE 'ValueError' END AS erro,"
        " CASE WHEN len(text) % 2 = 0 THEN len(text) ELSE 0 END AS prompt_tokens,"
        " CASE WHEN len(text) % 2 = 0 THEN 'echo' ELSE '' END AS modelo FROM questions",
        QUESTIONS_SQL,
    )
)
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function run over a prompt table; some calls fail on purpose."""

    def echo(prompt: str) -> tuple[str, str]:
        if len(prompt) % 2:
            raise ValueError(prompt)
        return f"echo: {prompt}", f'{{"prompt_tokens": {len(prompt)}, "modelo": "echo"}}'

    asked = questions(spark, sf_dir).withColumnRenamed("text", "prompt")
    tokens, *_, model = A.usage_fields(F.col("usage"))
    return A.generate(asked, echo).select("query_id", "answer", "ok", "erro", tokens, model)


@query(with_parts("SELECT query_id, rank, round(similarity, 4) AS score FROM hits", SEARCH_SQL))
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_points(index_of(spark, sf_dir), questions(spark, sf_dir))


@query(
    with_parts(
        "SELECT CAST(b.bin AS INTEGER) AS bin, round((b.bin + 0.5) / 10, 4) AS mid, count(h.bin) AS n"
        " FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT least(greatest(CAST(floor(round(similarity, 4) * 10)"
        " AS INTEGER), 0), 9) AS bin FROM hits) h ON b.bin = h.bin GROUP BY b.bin",
        SEARCH_SQL,
    )
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = score_points(index_of(spark, sf_dir), questions(spark, sf_dir))
    return histogram(points, "score", 10, 0.0, 1.0)
