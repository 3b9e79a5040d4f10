"""Published scores over the published knowledge base, if a copy of it is at hand.

Set PARITY_KB to the delimited file to run these.
"""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.plans.evaluate import evaluate_retrieval, score_points
from lodestone.plans.index import build_index, index_shape
from lodestone.plans.search import build_word_index, cascade_search, search_answers, semantic_search
from lodestone.sources.kb import PARITY_ENCODING, read_kb

KB = os.environ.get("PARITY_KB", "")
pytestmark = pytest.mark.skipif(not KB, reason="PARITY_KB is not set")

# Published queries and their scores.
GOLDEN = {
    "impressora com defeito": [0.1871, 0.1278, 0.1247],
    "wifi nao conecta": [0.1066, 0.0626, 0.0596],
    "senha do eduroam invalida": [0.2666, 0.1991, 0.1609],
    "software pirata instalacao": [0.2657, 0.2587, 0.1970],
    "acesso ao cafe dos professores": [0.1899, 0.1563, 0.1429],
    "visita do loco": [0.1924, 0.1809, 0.1517],
    "impressora travando": [0.3087, 0.3003, 0.2997],
    "esqueci a senha do sistema": [0.1548, 0.1065, 0.1042],
    "problema de suporte": [0.1358, 0.1220, 0.1086],
    "equipamento de impressao quebrado": [0.1740, 0.0970, 0.0941],
    "minha VPN nao conecta": [0.1226, 0.0947, 0.0933],
    "como configuro o email": [0.1222],
    "computador nao liga": [0.1498, 0.1382, 0.1283],
    "site da universidade fora do ar": [0.1304, 0.1149, 0.1128],
    "vpn corporativa": [],
}
GOLD = {
    "impressora com defeito": True,
    "wifi nao conecta": True,
    "vpn corporativa": True,
    "senha do eduroam invalida": True,
    "software pirata instalacao": True,
    "gosto de pizza": False,
    "como esta o tempo hoje": False,
    "musica preferida rock": False,
    "vou viajar amanha": False,
}


@pytest.fixture(scope="module")
def kb(spark):
    return read_kb(spark, KB, PARITY_ENCODING).cache()


@pytest.fixture(scope="module")
def index(kb):
    return build_index(kb, ["category", "rule", "description"], "rule")


def _queries(spark, texts):
    return spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")


def test_rows_and_shape(kb, index):
    assert [r[0] for r in kb.select("doc_id").orderBy("doc_id").collect()] == list(range(500))
    assert index_shape(index).first()["n_terms"] == 1375


def test_published_scores(spark, index):
    got = {q: [] for q in GOLDEN}
    for r in score_points(index, _queries(spark, GOLDEN)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["score"])
    assert got == {q: pytest.approx(s, abs=1.01e-4) for q, s in GOLDEN.items()}


def test_published_confusion(spark, index):
    gold = spark.createDataFrame(list(GOLD.items()), "query_id string, relevant boolean")
    row = evaluate_retrieval(semantic_search(index, _queries(spark, GOLD)), gold).first()
    assert row.asDict() == {"TP": 4, "FP": 1, "TN": 3, "FN": 1, "precision": 0.8, "recall": 0.8, "f1": 0.8}


def test_cascade_label_without_any_hit(spark, kb, index):
    queries = _queries(spark, ["vpn corporativa", "impressora com defeito"])
    hits = cascade_search(index, build_word_index(kb, ["category", "rule"], "rule"), queries)
    got = {r["query_id"]: (r["method"], r["n_hits"]) for r in search_answers(queries, hits).collect()}
    assert got["impressora com defeito"] == ("semantica", 3)
    assert got["vpn corporativa"][0] == "palavra_chave"


def test_balance(kb):
    counts = sorted(r["count"] for r in kb.groupBy("category").count().collect())
    assert counts == [89, 91, 105, 106, 109]
    assert kb.agg(F.countDistinct("rule")).first()[0] == 25
