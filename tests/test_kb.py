import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.operators.sizing import BROADCAST_CONF
from lodestone.plans import evaluate as E, profile as P, quiz as Q, rewrite as R
from lodestone.plans.index import build_index
from lodestone.sources.kb import KB_COLUMNS, PARITY_ENCODING, read_kb, write_kb
from lodestone.sources.reports import read_document, read_section, write_report

HEADER = ";".join(KB_COLUMNS)


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    lines = [HEADER] + [
        f'T{i};D{i % 2};M;{["Rede", "Inservível", "Acesso"][i % 3]};"texto; ""{i}"" é";regra {i % 4};acao {i % 5}'
        for i in range(40)
    ]
    path = tmp_path_factory.mktemp("kb") / "kb.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def kb(spark, file):
    return read_kb(spark, file).cache()


def test_read(kb):
    rows = kb.orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(40))
    assert [r["ticket_id"] for r in rows] == [f"T{i}" for i in range(40)]
    assert rows[3]["description"] == 'texto; "3" é'


def test_read_as_latin1_takes_bytes_for_letters(spark, file):
    rows = read_kb(spark, file, PARITY_ENCODING)
    assert rows.filter(F.col("category") == "InservÃ\xadvel").count() == 13


def test_missing_file_is_an_empty_table(spark, kb, tmp_path):
    empty = read_kb(spark, str(tmp_path / "no.csv"))
    assert empty.count() == 0 and empty.schema.simpleString() == kb.schema.simpleString()


def test_write_keeps_order_and_never_overwrites(spark, kb, tmp_path):
    path = str(tmp_path / "out")
    write_kb(kb.repartition(7), path)
    assert sorted(map(tuple, read_kb(spark, path).collect())) == sorted(map(tuple, kb.collect()))
    with pytest.raises(AnalysisException):
        write_kb(kb, path)


def _variants(spark):
    rows = [("REDE ", 0, "r0", "a0"), ("rede", 1, "r1", "a1"), ("inservivel", 0, "i0", "b0"), ("Email", 0, "e0", "c0")]
    return spark.createDataFrame(rows, "category string, slot int, rule string, action string")


@pytest.mark.parametrize("fits", [True, False])
def test_rewrite_goes_round(spark, kb, fits):
    if not fits:
        spark.conf.set(BROADCAST_CONF, "-1")
    try:
        new = R.rewrite_kb(kb, _variants(spark)).orderBy("doc_id").collect()
    finally:
        spark.conf.unset(BROADCAST_CONF)
    old = kb.orderBy("doc_id").collect()
    assert [r["rule"] for r in new if r["category"] == "Rede"] == [f"r{i % 2}" for i in range(14)]
    assert {(r["rule"], r["action"]) for r in new if r["category"] == "Inservível"} == {("i0", "b0")}
    same = [(a, b) for a, b in zip(old, new) if a["category"] == "Acesso"]
    assert same and all(a == b for a, b in same)
    assert [r["category"] for r in R.unknown_categories(kb, _variants(spark)).collect()] == ["Email"]


def test_profile(spark, kb):
    index = build_index(kb, ["category", "rule", "description"], "rule")
    report = P.profile_kb(kb, index)
    balance = {(r["category"], r["is_total"]): r["n"] for r in report["balance"].collect()}
    assert balance[(None, 1)] == 40 and balance[("Rede", 0)] == 14
    assert {r["category"]: (r["n_rows"], r["n_rules"]) for r in report["redundant"].collect()}["Rede"] == (14, 4)
    holes = kb.withColumn("rule", F.when(F.col("doc_id") > 4, F.col("rule")))
    assert {r["column_name"]: r["n_null"] for r in P.null_counts(holes).collect()}["rule"] == 5
    lengths = report["lengths"].first()
    assert (lengths["n"], lengths["min"], lengths["max"], lengths["q50"]) == (40, 12, 13, 13.0)
    nothing = P.length_summary(holes.withColumn("x", F.lit(None).cast("string")), "x").collect()
    assert nothing == [] or nothing[0]["n"] == 0
    rare = [r["term"] for r in report["rarest_terms"].collect()]
    assert len(rare) == 15 and report["index_shape"].first()["n_docs"] == 40


@pytest.mark.parametrize("n", [None, 7])
def test_quiz(kb, n):
    quiz = Q.make_quiz(kb, "s1", n).collect()
    actions = {r["doc_id"]: r["action"] for r in kb.collect()}
    items = {}
    for r in quiz:
        items.setdefault(r["item_id"], []).append(r)
    assert len(items) == (n or 40)
    for item, options in items.items():
        assert sorted(o["option_letter"] for o in options) == ["A", "B", "C"]
        assert len({o["action"] for o in options}) == 3
        assert [o["action"] for o in options if o["is_correct"]] == [actions[item]]
    if n is None:
        assert {o["option_letter"] for o in quiz if o["is_correct"]} == {"A", "B", "C"}
    assert sorted(map(tuple, Q.make_quiz(kb.repartition(5), "s1", n).collect())) == sorted(map(tuple, quiz))


def test_quiz_needs_three_actions(kb):
    with pytest.raises(ValueError):
        Q.make_quiz(kb.filter("action in ('acao 0', 'acao 1')"))


@pytest.mark.parametrize("fits", [True, False])
def test_grade(spark, kb, fits):
    quiz = Q.make_quiz(kb, "s1")
    keys = {r["item_id"]: r["key"] for r in Q.answer_key(quiz).collect()}
    rows = [(7, "abcABCx "[i % 8]) for i in range(60)] + [(i, "b") for i in range(40)] + [(999, "A")]
    responses = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "response_id int, item_id long, response string")
    if not fits:
        spark.conf.set(BROADCAST_CONF, "-1")
    try:
        got = {r["response_id"]: r["correct"] for r in Q.grade(responses, quiz).collect()}
    finally:
        spark.conf.unset(BROADCAST_CONF)
    assert got == {i: resp.upper() == keys[item] for i, (item, resp) in enumerate(rows) if item != 999}


def test_confusion(spark):
    hits = spark.createDataFrame([(1, 0.5), (1, 0.2), (2, 0.0999), (3, 0.1)], "query_id long, similarity double")
    gold = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "query_id long, relevant boolean")
    assert tuple(E.evaluate_retrieval(hits, gold).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    nothing = E.evaluate_retrieval(hits.limit(0), gold.filter("not relevant")).first()
    assert tuple(nothing) == (0, 0, 2, 0, 0.0, 0.0, 0.0)


def test_run_summary(spark):
    rows = [("a", 1.04, True), ("a", 2.0, False), ("b", 0.5, True)]
    got = E.run_summary(spark.createDataFrame(rows, "class string, ms double, ok boolean")).first()
    assert tuple(got) == (3, 2, 3.5, 2)


def test_report_files(spark, tmp_path):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    path = str(tmp_path / "report")
    write_report({"one": one, "two": one.limit(0)}, path)
    assert sorted(map(tuple, read_section(spark, path, "one", "k string, n long").collect())) == [("a", 1), ("b", 2)]
    doc = tmp_path / "doc.json"
    doc.write_text('{\n "times": [{"id": "x", "ms": 1.5},\n {"id": "y", "ms": 2}],\n "more": {"a": 1}\n}')
    rows = read_document(spark, str(doc), "times", "id string, ms double").collect()
    assert [tuple(r) for r in rows] == [("x", 1.5), ("y", 2.0)]
