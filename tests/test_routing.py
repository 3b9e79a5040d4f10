import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import answers as A
from lodestone.plans.evaluate import evaluate_intent, intent_table
from lodestone.plans.index import build_index
from lodestone.plans.search import build_word_index
from lodestone.plans.intent import DEFAULT_LEXICON, GOODBYE, GREETING, THANKS, Lexicon, classify_intent

# Published phrases and the class each of them gets.
PUBLISHED = {
    GREETING: ["oi", "Ola!", "bom dia", "oi galera", "bom dia meu amigo", "olá!"],
    THANKS: [
        "obrigado", "Obrigado!", "muito obrigado", "valeu", "obrigado pela ajuda", "valeu demais",
        "brigadao pela forca", "obrigado amigo", "muito obrigado mesmo", "OBRIGADO",
    ],
    GOODBYE: ["tchau", "Ate logo!", "tchau pessoal", "ate mais galera"],
    None: ["obrigado, mas e a VPN?", "valeu, mas a impressora nao funciona", "oi, como configuro o wifi?"],
}


def _intents(spark, texts, lexicon=DEFAULT_LEXICON):
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return [r["intent"] for r in classify_intent(df, lexicon).orderBy("query_id").collect()]


def test_published_phrases(spark):
    rows = [(label or "mista", p) for label, phrases in PUBLISHED.items() for p in phrases]
    got = evaluate_intent(spark.createDataFrame(rows, "esperado string, frase string"))
    assert [(r["esperado"], r["frase"]) for r in got.collect() if r["obtido"] != r["esperado"]] == [
        ("mista", p) for p in PUBLISHED[None]
    ]
    table = {r["esperado"]: r.asDict() for r in intent_table(got, [GREETING, THANKS, GOODBYE]).collect()}
    assert table[THANKS] == {"esperado": THANKS, GREETING: 0, THANKS: 10, GOODBYE: 0}
    assert sum(table["mista"][c] for c in (GREETING, THANKS, GOODBYE)) == 0


def test_edges_of_the_classifier(spark):
    texts = [None, "", "  ", "?!", "mais", "muito", "dia", "e", "obrigado; tchau", "bye obrigado", "e aí", "oi (oi)"]
    assert _intents(spark, texts) == [
        None, None, None, None, GOODBYE, THANKS, GREETING, GREETING, None, None, GREETING, None
    ]


def test_whole_phrases_come_before_anchors(spark):
    lexicon = Lexicon((("first", ("good one",)), ("second", ("good", "one two"))), ("so",))
    assert _intents(spark, ["good", "good so", "one", "good one", "so", "two one"], lexicon) == [
        "second", "first", "first", "first", None, "second"
    ]


def test_lexicon_as_rows(spark):
    rows = DEFAULT_LEXICON.rows(spark)
    assert rows.filter("kind = 'anchor' and phrase = 'ola'").count() == 1
    assert rows.filter(F.col("phrase").rlike("[áéàã]")).count() == 0


@pytest.fixture(scope="module")
def kb(spark):
    rows = [
        (0, "rede", "reiniciar o roteador", "wifi lento na sala", "ligar"),
        (1, "rede", "trocar o cabo", "cabo de rede partido", "trocar"),
        (2, "acesso", "redefinir a senha", "senha esquecida", "redefinir"),
    ]
    return spark.createDataFrame(rows, "doc_id long, category string, rule string, description string, action string")


@pytest.fixture(scope="module")
def index(kb):
    return build_index(kb, ["category", "rule", "description"], "rule")


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(1, "oi"), (2, "  "), (3, "wifi lento"), (4, "esque"), (5, "qqqq wwww"), (6, "roteadores novos?"), (7, "otead")]
    return spark.createDataFrame(rows, "query_id long, text string")


def test_answer_batch(messages, index, kb):
    words = build_word_index(kb, ["category", "rule"], "rule")
    got = {r["query_id"]: r for r in A.answer_batch(messages, index, words, kb).collect()}
    assert len(got) == 7
    assert (got[1]["status"], got[1]["method"], got[1]["intent"]) == ("ok", "cortesia", GREETING)
    assert got[1]["reply"] == A.REPLIES[GREETING] and got[1]["n_hits"] == 0
    assert (got[2]["status"], got[2]["method"]) == ("empty_query", None)
    assert got[3]["method"] == "semantica" and got[3]["top_score"] > 0.05
    assert got[3]["hits"][0]["rule"] == "reiniciar o roteador"
    assert (got[4]["method"], got[4]["n_hits"], got[4]["top_score"]) == ("palavra_chave", 0, 0.0)
    assert (got[7]["method"], got[7]["n_hits"], got[7]["top_score"]) == ("palavra_chave", 1, 0.0)
    assert got[5]["n_hits"] == 0


def test_no_knowledge_base(messages):
    answers = A.answer_batch(messages, None, None, None)
    rows = answers.collect()
    got = {r["query_id"]: r["status"] for r in rows}
    assert {r["query_id"]: r["reply"] for r in rows}[3] == A.NO_KB
    assert got[1] == "ok" and got[2] == "empty_query" and got[3] == "kb_unavailable"
    log = A.request_events(answers, F.current_timestamp(), F.lit(1.23456)).collect()
    assert len(log) == 6
    failed = [r for r in log if not r["ok"]]
    assert len(failed) == 5 and {r["metodo"] for r in failed} == {"nenhum"}


def test_request_events(spark):
    answers = spark.createDataFrame(
        [(1, "ok", "semantica", 0.123456), (2, "ok", "cortesia", float("nan")), (3, "empty_query", None, 0.0)],
        "query_id long, status string, method string, top_score double",
    )
    at = F.lit("2024-01-01 10:00:00.5").cast("timestamp")
    rows = {r["metodo"]: r for r in A.request_events(answers, at, F.lit(12.34567)).collect()}
    assert set(rows) == {"semantica", "cortesia"}
    assert rows["semantica"].asDict() == {
        "ts": "2024-01-01T10:00:00.500Z", "endpoint": "api_consulta", "metodo": "semantica", "modelo": "", "ok": True,
        "erro": "", "duracao_ms": 12.346, "prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0,
        "top_score": 0.1235,
    }
    assert rows["cortesia"]["top_score"] == 0.0


def test_prompts(spark):
    queries = spark.createDataFrame([(1, "why {facts}?"), (2, "what")], "query_id long, text string")
    hits = spark.createDataFrame(
        [(1, 2, "c2", "r2", "a2", None), (1, 1, "c1", "r1", "a1", 0.456)],
        "query_id long, rank long, category string, rule string, action string, similarity double",
    )
    got = {r["query_id"]: r["prompt"] for r in A.build_prompts(queries, hits, "{k}|{facts}|{question}", 2).collect()}
    first = "- category: c1 | rule: r1 | action: a1 (score 0.46)\n- category: c2 | rule: r2 | action: a2"
    assert got == {1: f"2|{first}|why {{facts}}?", 2: f"2|{A.NO_FACTS}|what"}


def test_generate_and_its_log(spark):
    def fn(prompt):
        if prompt == "bad":
            raise KeyError(prompt)
        return prompt.upper(), json.dumps({"prompt_tokens": 3, "total_tokens": None, "modelo": "m"})

    prompts = spark.createDataFrame([("a", "hello"), ("b", "bad")], "query_id string, prompt string")
    results = A.generate(prompts, fn)
    rows = {r["query_id"]: r for r in results.collect()}
    assert rows["a"]["answer"] == "HELLO" and rows["a"]["ok"] and rows["a"]["duracao_ms"] >= 0
    assert (rows["b"]["ok"], rows["b"]["erro"], rows["b"]["answer"]) == (False, "KeyError", None)
    log = {r["ok"]: r for r in A.generation_events(results, F.current_timestamp()).collect()}
    assert (log[True]["prompt_tokens"], log[True]["total_tokens"], log[True]["modelo"]) == (3, 0, "m")
    assert (log[False]["erro"], log[False]["prompt_tokens"], log[False]["endpoint"]) == ("KeyError", 0, "llm")


def test_rows_of_hits_are_fetched_only_where_they_are_read(spark):
    rows = [(i, "c", f"rede lenta {i}", f"a{i}") for i in range(20)]
    kb = spark.createDataFrame(rows, "doc_id long, category string, rule string, action string")
    index = build_index(kb, ["category", "rule"], "rule", buckets=2)
    words = build_word_index(kb, ["category", "rule"], "rule")
    broken = kb.withColumn("action", F.raise_error(F.concat(F.lit("read "), "action")).cast("string"))
    asked = spark.createDataFrame([("a", "rede 7"), ("b", "Rede, 7!"), ("c", "lenta"), ("d", " ")], "query_id string, text string")
    answers = A.answer_batch(asked, index, words, broken)
    got = {r["query_id"]: (r["status"], r["n_hits"]) for r in answers.drop("hits").collect()}
    assert got == {"a": ("ok", 3), "b": ("ok", 3), "c": ("ok", 3), "d": ("empty_query", 0)}
    whole = {r["query_id"]: r["hits"] for r in A.answer_batch(asked, index, words, kb).collect()}
    assert [h["action"] for h in whole["a"]] == [h["action"] for h in whole["b"]] and len(whole["c"]) == 3 and whole["d"] is None


def test_facts_of_nested_hits_are_those_of_their_rows(spark):
    columns = "query_id long, rank long, similarity double, category string, rule string, action string"
    rows = [(1, 2, None, "c", "r2", "a"), (1, 1, 0.5, "c", "r1", "a"), (2, 1, 0.25, "c", None, "a"), (3, 1, 0.1, "d", "r", "b")]
    hits = spark.createDataFrame(rows, columns)
    nested = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "similarity", "category", "rule", "action"))).alias("hits"))
    got = nested.select("query_id", A.nested_facts(F.col("hits")).alias("facts"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, A.fact_texts(hits).collect()))
    none = nested.select(A.nested_facts(F.filter("hits", lambda h: h["rank"] > 9)).alias("e"), A.nested_facts(F.lit(None).cast(nested.schema["hits"].dataType)).alias("n"))
    assert none.distinct().collect() == [(None, None)]
