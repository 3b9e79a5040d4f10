import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions.scalars import wall_clock_hour
from lodestone.plans import usage as U
from lodestone.plans.answers import generate, request_events, with_replies
from lodestone.sources.events import EVENT_SCHEMA, LINE_ORDER, append_events, parse_events, read_events
from lodestone.streaming.usage import merge_days, merge_rollup, start_rollup

LINES = [
    '{"ts": "2024-01-01T10:00:00.000Z", "endpoint": "api_consulta", "metodo": "semantica", "ok": true, "duracao_ms": 4.0, "top_score": 0.31239}',
    "",
    "{bad",
    "[1]",
    '{"ts": "2024-01-01T10:30:00.000Z", "endpoint": "api_consulta", "metodo": "semantica", "duracao_ms": 6.0}',
    '{"ts": "2024-01-01T23:00:00.000-03:00", "endpoint": "api_consulta", "metodo": "", "ok": null, "duracao_ms": 1}',
    '{"ts": "soon", "endpoint": "api_consulta", "ok": true, "top_score": NaN, "duracao_ms": null}',
    '{"ts": "2024-01-01T11:00:00.000Z", "endpoint": "llm", "modelo": "m1", "ok": true, "prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 15}',
    '{"ts": "2024-01-01T11:00:01.000Z", "endpoint": "llm", "modelo": "", "ok": false, "prompt_tokens": 7, "total_tokens": 7}',
    '{"ts": "2024-01-01T11:00:02.000Z", "endpoint": "llm", "modelo": "m1", "prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}',
    '{"endpoint": "other"} trailing',
    '{"endpoint": "other"}',
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "usage.jsonl"
    path.write_text("\n".join(LINES) + "\n")
    return read_events(spark, str(path)).withColumn("event_id", F.col("src_row")).cache()


def test_lines(events):
    rows = events.orderBy(*LINE_ORDER).collect()
    assert len(rows) == 8
    assert [r["ok"] for r in rows] == [True, True, False, True, True, False, True, True]
    assert rows[3]["top_score"] != rows[3]["top_score"]


def test_report(events):
    report = U.usage_report(events, LINE_ORDER)
    assert report["llm_usage"].first().asDict() == {
        "disponivel": True, "n_eventos": 8, "n_eventos_llm": 3, "n_eventos_api": 4, "n_erros": 2,
        "total_tokens": 25, "prompt_tokens_total": 18, "completion_tokens_total": 7,
    }
    assert [tuple(r) for r in report["modelos"].collect()] == [("m1", 2)]
    hours = {r["hour"]: r["n"] for r in report["horas"].collect()}
    assert len(hours) == 24 and {h: n for h, n in hours.items() if n} == {10: 2, 11: 3, 23: 1}
    calls = [tuple(r) for r in report["tokens_por_chamada"].orderBy("chamada").collect()]
    assert calls == [(1, 10, 5), (2, 1, 2)]
    latency = {r["metodo"]: tuple(r)[1:] for r in report["latencia_por_metodo"].collect()}
    assert latency == {"semantica": (2, 5.0, 5.9, 6.0), "nenhum": (2, 0.5, 0.95, 1.0)}
    assert {r["metodo"]: r["n"] for r in report["mix_de_metodos"].collect()} == {"semantica": 2, "nenhum": 2}
    assert [r["top_score"] for r in report["top_scores"].collect()] == [0.3124]


def test_empty_log(spark, tmp_path):
    events = read_events(spark, str(tmp_path / "none.jsonl")).withColumn("event_id", F.lit(1))
    report = U.usage_report(events, LINE_ORDER)
    assert report["llm_usage"].first().asDict() == {
        "disponivel": False, "n_eventos": 0, "n_eventos_llm": 0, "n_eventos_api": 0, "n_erros": 0,
        "total_tokens": 0, "prompt_tokens_total": 0, "completion_tokens_total": 0,
    }
    assert sum(r["n"] for r in report["horas"].collect()) == 0
    for name in ("modelos", "tokens_por_chamada", "latencia_por_metodo", "mix_de_metodos", "top_scores"):
        assert report[name].collect() == []


def test_repeated_batches_are_appended_once(spark, events, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        append_events(events.filter("ok"), path, "b-1")
        append_events(events.filter("not ok"), path, "b-2")
    assert read_events(spark, path).count() == 8
    # an append broken off before its note: what it left is replaced
    os.remove(os.path.join(path, "_commits", "b-1"))
    append_events(events.filter("ok"), path, "b-1")
    append_events(events.filter("ok"), path)
    assert read_events(spark, path).count() == 14
    with pytest.raises(ValueError):
        append_events(events, path, "a/b")


def test_counts_of_one_scan_equal_the_sections(spark, events):
    for log in (events, events.filter("false")):
        cells = U.count_cells(log)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert plan.count("InMemoryTableScan") <= 1
        found = U.count_sections(cells)
        want = {"llm_usage": U.totals, "modelos": U.calls_per_model, "horas": U.events_per_hour, "mix_de_metodos": U.method_mix}
        for section, alone in want.items():
            assert sorted(map(tuple, found[section].collect())) == sorted(map(tuple, alone(log).collect())), section
            assert found[section].columns == alone(log).columns


def test_append_twice(spark, events, tmp_path):
    path = str(tmp_path / "log")
    append_events(events.filter("ok"), path)
    append_events(events.filter("not ok"), path)
    back = read_events(spark, path)
    assert back.count() == 8
    assert back.filter("not ok").count() == 2
    one = back.filter("modelo = 'm1' and prompt_tokens = 10").first()
    assert (one["total_tokens"], one["ts"]) == (15, "2024-01-01T11:00:00.000Z")


def _line(minute, method, **more):
    at = dt.datetime(2024, 3, 1, 8) + dt.timedelta(minutes=minute)
    return json.dumps({"ts": at.isoformat() + ".000Z", "endpoint": "api_consulta", "metodo": method, "ok": True,
                       "duracao_ms": float(minute), "total_tokens": minute, "top_score": 0.5, **more})


def _write(folder, name, lines, age):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def _rows(df):
    return sorted((str(r["hour_start"]), r["metodo"], r["n"], r["total_tokens"], r["ms_max"]) for r in df.collect())


def _run(spark, source, state, mode):
    got = []

    def keep(batch, _):
        got.append([r.asDict() for r in batch.collect()])

    start_rollup(spark, str(source), str(state), keep, mode, maxFilesPerTrigger="1").awaitTermination()
    return got


def test_stream_in_update_mode_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    _write(log, "a.json", [_line(m, "x" if m % 3 else "y") for m in range(0, 100, 5)], 0)
    _write(log, "b.json", [_line(m, "x") for m in range(95, 200, 5)], 10)
    live = {}
    for changes in _run(spark, log, tmp_path / "state", "update"):
        live.update({(r["hour_start"], r["metodo"]): r for r in changes})
    batch = {(r["hour_start"], r["metodo"]): r.asDict()
             for r in U.hourly_rollup(read_events(spark, str(log))).collect()}
    assert live == batch
    # a second run over the same folder has nothing new
    _write(log, "c.json", [_line(195, "y")], 20)
    again = [r for changes in _run(spark, log, tmp_path / "state", "update") for r in changes]
    assert [(r["metodo"], r["n"]) for r in again] == [("y", 1)]


def test_stream_in_append_mode_gives_closed_hours_and_drops_late_rows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    _write(log, "a.json", [_line(m, "x") for m in (0, 30, 65, 150)], 0)
    _write(log, "b.json", [_line(151, "x")], 10)
    _write(log, "c.json", [_line(10, "x"), _line(152, "x")], 20)  # minute 10 is long past the watermark
    got = [r for batch in _run(spark, log, tmp_path / "state", "append") for r in batch]
    assert sorted((r["hour_start"].hour, r["n"]) for r in got) == [(8, 2), (9, 1)]


def test_merge(spark):
    schema = "hour_start int, metodo string, n long"
    old = spark.createDataFrame([(1, "x", 1), (2, "x", 5)], schema)
    new = spark.createDataFrame([(2, "x", 6), (2, "y", 1)], schema)
    assert sorted(map(tuple, merge_rollup(old, new).collect())) == [(1, "x", 1), (2, "x", 6), (2, "y", 1)]
    assert merge_rollup(None, new) is new


def test_merge_writes_only_changed_days(spark, tmp_path):
    path = str(tmp_path / "live")

    def batch(*rows):
        return spark.createDataFrame(rows, "at string, metodo string, n long").select(
            F.to_timestamp("at").alias("hour_start"), "metodo", "n"
        )

    merge_days(batch(("2024-01-01 08:00:00", "x", 1), ("2024-01-02 09:00:00", "x", 5)), path)
    kept = sorted(p.name for p in (tmp_path / "live" / "day=2024-01-01").iterdir())
    change = batch(("2024-01-02 09:00:00", "x", 6), ("2024-01-02 10:00:00", "y", 1))
    for _ in range(2):  # a repeated batch changes nothing
        merge_days(change, path)
    got = spark.read.parquet(path).select(F.date_format("hour_start", "dd HH").alias("h"), "metodo", "n").collect()
    assert sorted(map(tuple, got)) == [("01 08", "x", 1), ("02 09", "x", 6), ("02 10", "y", 1)]
    assert sorted(p.name for p in (tmp_path / "live" / "day=2024-01-01").iterdir()) == kept


def test_schema_of_an_absent_log(spark, tmp_path):
    absent = read_events(spark, str(tmp_path / "nothing"))
    assert absent.drop(*LINE_ORDER).schema == spark.createDataFrame([], EVENT_SCHEMA).schema


def test_only_whole_objects_are_lines(spark):
    bad = ['{"endpoint":"llm"}] junk', '{"endpoint":"llm"} junk', '{"endpoint":"llm"}, {"a": 1}', '{"endpoint":"llm"},{"a":1}] x', "", "[1]", "null", '{"endpoint"']
    assert parse_events(spark.createDataFrame([(line,) for line in bad], "value string")).count() == 0
    good = ['{"ok": []}', '{"ok": {}}', ' {"ok": true} ', "{}"]
    got = parse_events(spark.createDataFrame([(i, line) for i, line in enumerate(good)], "i int, value string"), "i")
    assert [r["ok"] for r in got.orderBy("i").collect()] == [False, False, True, True]


def test_hours_need_a_whole_date(spark):
    hours = {
        "2024": None, "2024-05": None, "at 2024-05-01T10:00:00": None, "2024-05-01": 0, "2024-05-01T23:59:59Z": 23,
        "20240501T101112": 10, "20240501T1011": 10, "20240501": 0, None: None,
    }
    df = spark.createDataFrame([(t,) for t in hours], "t string")
    assert {r["t"]: r["h"] for r in df.select("t", wall_clock_hour(F.col("t")).alias("h")).collect()} == hours


def test_failed_generation_reaches_answer_and_log(spark):
    answers = spark.createDataFrame(
        [(1, "ok", "semantica", None, 0.5), (2, "ok", "semantica", None, 0.4), (3, "ok", "cortesia", "Hello.", 0.0)],
        "query_id int, status string, method string, reply string, top_score double",
    )

    def fn(prompt: str) -> tuple[str, str]:
        if prompt == "bad":
            raise TimeoutError
        return prompt.upper(), "{}"

    made = generate(spark.createDataFrame([(1, "good"), (2, "bad")], "query_id int, prompt string"), fn)
    full = with_replies(answers, made)
    got = {r["query_id"]: (r["status"], r["erro"], r["reply"]) for r in full.collect()}
    assert got == {1: ("ok", "", "GOOD"), 2: ("generation_failed", "TimeoutError", None), 3: ("ok", "", "Hello.")}
    log = request_events(full, F.current_timestamp(), F.lit(1.0)).collect()
    assert sorted((r["ok"], r["erro"]) for r in log) == [(False, "TimeoutError"), (True, ""), (True, "")]
