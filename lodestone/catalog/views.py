"""The given tables in the roles the operators expect, once for Spark and once as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.plans.index import TextIndex, build_index
from lodestone.plans.intent import Lexicon
from lodestone.plans.search import WordIndex, build_word_index
from lodestone.session import checkpoint_dir

SEARCH_COLS = ("category", "rule")
INDEX_COLS = ("category", "rule", "description")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedup_key() -> Column:
    return F.md5("rule")


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a knowledge base: the text is the rule, its language the category."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("category"),
        F.col("text").alias("rule"),
        F.col("source").alias("description"),
        F.concat_ws("/", "lang", "source").alias("action"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "user")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every user turn as a message, blank ones included."""
    return (
        user_turns(spark, sf_dir)
        .select("conv_id", "turn", F.posexplode_outer(F.split("text", "[.\n]")).alias("pos", "text"))
        .select(F.concat_ws("-", "conv_id", "turn", "pos").alias("query_id"), "text")
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a usage log."""
    kind = F.col("event_type")
    llm = kind.isin("purchase", "signup")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        F.when(llm, F.lit("llm")).otherwise(F.lit("api_consulta")).alias("endpoint"),
        F.when(kind == "view", F.lit("")).otherwise(kind).alias("metodo"),
        F.when(llm, kind).otherwise(F.lit("")).alias("modelo"),
        (kind != "error").alias("ok"),
        F.when(kind == "error", F.lit("Failed")).otherwise(F.lit("")).alias("erro"),
        (F.col("value") / 0.733).alias("duracao_ms"),
        k.alias("prompt_tokens"),
        (k * 2).alias("completion_tokens"),
        (k * 3).alias("total_tokens"),
        (F.col("value") / 733).alias("top_score"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as rule variants; category names differ in case and accents."""
    names = F.array(F.lit("DE"), F.lit("én"), F.lit(" Fr "), F.lit("es"), F.lit("pt"))
    return table(spark, sf_dir, "benchmark").select(
        F.get(names, F.pmod("item_id", F.lit(5)).cast("int")).alias("category"),
        F.floor(F.col("item_id") / 5).cast("long").alias("slot"),
        F.md5("text").alias("rule"),
        F.col("text").alias("action"),
    )


# Words of the invented prose, so that every class occurs among the sentences.
PROSE_LEXICON = Lexicon(
    classes=(
        ("closing", ("la que", "von", "of the end")),
        ("thanking", ("und der", "The And", "ré")),
        ("opening", ("in", "un", "dé la", "ed")),
    ),
    neutral=("a", "is", "it", "to", "die", "le", "el", "que", "that", "was"),
)

_INDEXES: dict[tuple[str, str, str], TextIndex] = {}
_WORDS: dict[tuple[str, str], WordIndex] = {}


def index_of(spark: SparkSession, sf_dir: str, which: str = "kb") -> TextIndex:
    """Build an index once per session and folder; searches share it."""
    key = (spark.sparkContext.applicationId, sf_dir, which)
    if key not in _INDEXES:
        if which == "kb":
            _INDEXES[key] = build_index(kb(spark, sf_dir), INDEX_COLS, dedup_key())
        else:
            passages = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
            _INDEXES[key] = build_index(passages, ["text"], F.md5("text"))
    return _INDEXES[key]


def words_of(spark: SparkSession, sf_dir: str) -> WordIndex:
    """The index of words, built once per session and folder as well."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WORDS:
        _WORDS[key] = build_word_index(kb(spark, sf_dir), SEARCH_COLS, dedup_key())
    return _WORDS[key]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder beside the checkpoints, where every executor can write."""
    return f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


# --- the same roles as SQL -------------------------------------------------------------

KB_SQL = (
    "kb AS (SELECT doc_id, lang AS category, text AS rule, source AS description,"
    " lang || '/' || source AS action, md5(text) AS dedup_key FROM documents)"
)
QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"
SENTENCES_SQL = (
    "turns AS (SELECT conv_id, turn, string_split_regex(text, '[.\\n]') AS s FROM conversations WHERE role = 'user'),\n"
    "sentences AS (SELECT conv_id || '-' || turn || '-' || (p - 1) AS query_id, s[p] AS text"
    " FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS p FROM turns))"
)
USAGE_SQL = (
    "usage AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts, ts AS ts_raw,"
    " CASE WHEN event_type IN ('purchase', 'signup') THEN 'llm' ELSE 'api_consulta' END AS endpoint,"
    " CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS metodo,"
    " CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE '' END AS modelo,"
    " event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'Failed' ELSE '' END AS erro,"
    " value / 0.733 AS duracao_ms, CAST(props ->> '$.k' AS BIGINT) AS prompt_tokens,"
    " CAST(props ->> '$.k' AS BIGINT) * 2 AS completion_tokens, CAST(props ->> '$.k' AS BIGINT) * 3 AS total_tokens,"
    " value / 733 AS top_score FROM events)"
)
VARIANTS_SQL = (
    "variants AS (SELECT ['DE', 'én', ' Fr ', 'es', 'pt'][item_id % 5 + 1] AS category, item_id // 5 AS slot,"
    " md5(text) AS rule, text AS action FROM benchmark)"
)


def form_sql(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({text}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def social_sql(text: str) -> str:
    return (
        f"trim(regexp_replace(translate(strip_accents(lower(coalesce({text}, ''))), '!?,.', '    '),"
        " '\\s+', ' ', 'g'))"
    )


def key_sql(text: str) -> str:
    return f"lower(regexp_replace(strip_accents({text}), '^\\s+|\\s+$', '', 'g'))"


def _terms_sql(name: str, source: str, key: str, text: str) -> str:
    """Tables ``{name}_toks`` and ``{name}_tf`` (key, term, tf)."""
    return (
        f"{name}_toks AS (SELECT {key}, regexp_extract_all({form_sql(text)}, '[a-z0-9]{{2,}}') AS t FROM {source}),\n"
        f"{name}_occ AS (SELECT {key}, unnest(list_concat(t, list_transform(list_zip(t[1:len(t)-1], t[2:]),"
        f" lambda x: x[1] || ' ' || x[2]))) AS term FROM {name}_toks),\n"
        f"{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM {name}_occ GROUP BY ALL)"
    )


def index_sql(source: str = "kb", text: str = "concat_ws(' ', category, rule, description)", cap: int | None = None) -> str:
    """Tables ``vocab`` (term, tf, df, idf; all terms unless capped) and ``weights`` (doc_id, dedup_key, term, tf, w)."""
    return (
        _terms_sql("doc", source, "doc_id", text) + ",\n"
        "vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df,"
        f" ln((1 + (SELECT count(*) FROM {source}))::DOUBLE / (1 + count(*))) + 1 AS idf"
        " FROM doc_tf GROUP BY term" + (f" ORDER BY sum(tf) DESC, term LIMIT {cap}" if cap else "") + "),\n"
        "raw AS (SELECT doc_id, term, doc_tf.tf, doc_tf.tf * idf AS r FROM doc_tf JOIN vocab USING (term)),\n"
        "weights AS (SELECT raw.doc_id, dedup_key, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY raw.doc_id)) AS w"
        f" FROM raw JOIN {source} ON raw.doc_id = {source}.doc_id)"
    )


def vectors_sql(source: str = "questions") -> str:
    """Table ``vectors`` (query_id, term, tf, qw)."""
    return (
        _terms_sql("ask", source, "query_id", "text") + ",\n"
        "asked AS (SELECT query_id, term, ask_tf.tf, ask_tf.tf * idf AS r FROM ask_tf JOIN vocab USING (term)),\n"
        "vectors AS (SELECT query_id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY query_id)) AS qw FROM asked)"
    )


PAIRS_SQL = (
    "pairs AS (SELECT query_id, doc_id, dedup_key, round(sum(w * qw), 10) AS score"
    " FROM weights JOIN vectors USING (term) GROUP BY ALL)"
)
HITS_SQL = (
    "best AS (SELECT query_id, dedup_key, score, doc_id FROM pairs WHERE score > 0.05"
    " QUALIFY row_number() OVER (PARTITION BY query_id, dedup_key ORDER BY score DESC, doc_id DESC) = 1),\n"
    "hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank,"
    " doc_id, dedup_key, score AS similarity FROM best QUALIFY rank <= 3)"
)
SEARCH_SQL = ",\n".join([KB_SQL, QUESTIONS_SQL, index_sql(), vectors_sql(), PAIRS_SQL, HITS_SQL])


def words_sql(source: str = "questions") -> str:
    """Tables ``words`` (query_id, word), ``forms`` (doc_id, dedup_key, form) and ``word_hits``."""
    return (
        "words AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(string_split("
        f"{form_sql('text')}, ' ')) AS word FROM {source}) WHERE len(word) > 3),\n"
        f"forms AS (SELECT doc_id, dedup_key, {form_sql(chr(32).join(['concat_ws(', repr(' '), ', category, rule)']))}"
        " AS form FROM kb),\n"
        "held AS (SELECT doc_id, dedup_key, word FROM forms JOIN (SELECT DISTINCT word FROM words)"
        " ON contains(form, word)),\n"
        "word_hits AS (SELECT DISTINCT query_id, doc_id, dedup_key FROM held JOIN words USING (word)),\n"
        "first_rows AS (SELECT query_id, dedup_key, min(doc_id) AS doc_id FROM word_hits GROUP BY ALL),\n"
        "word_top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank,"
        " doc_id, dedup_key FROM first_rows QUALIFY rank <= 3)"
    )
