import re
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scalars, text as T

SAMPLES = [
    None, "", "   ", "EDUROAM", "São Paulo, às 10h!", "Inservível / não-liga", "élève", "ß ø æ ł",
    "a b cc d ee", "Ωmega ά Й", "tab\tand\nline", " nbsp em\x1fsep", "İstanbul", "x" * 50, "1 22 333", "ﬁ",
    "ação-ÇÃO", "日本語 text", "o'clock",
]


def _strip(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _search(text):
    return re.sub("[^a-z0-9]+", " ", _strip((text or "").lower())).strip()


def _social(text):
    return " ".join(re.sub("[!?,.]", " ", _strip((text or "").lower())).split())


def _rows(spark, texts, **columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()


def test_forms_against_plain_python(spark):
    rows = _rows(
        spark, SAMPLES,
        search=T.search_form(F.col("t")), social=T.social_form(F.col("t")), key=T.category_key(F.col("t")),
        toks=T.tokens(F.col("t")), some=T.has_text(F.col("t")),
    )
    for text, row in zip(SAMPLES, rows):
        assert row["search"] == _search(text)
        assert row["social"] == _social(text)
        assert row["toks"] == [w for w in _search(text).split() if len(w) >= 2]
        assert row["some"] == bool((text or "").strip())
        assert row["key"] == (None if text is None else _strip(text).strip().lower())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=40), min_size=30, max_size=60))
def test_search_form_on_latin_text(spark, texts):
    rows = _rows(spark, texts, search=T.search_form(F.col("t")), toks=T.tokens(F.col("t")))
    for text, row in zip(texts, rows):
        assert row["search"] == _search(text)
        assert row["toks"] == [w for w in _search(text).split() if len(w) >= 2]


def test_ngrams_and_runs(spark):
    texts = ["", "um", "um dois", "um dois tres um"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", T.tokens(F.col("t")).alias("k")
    )
    got = [r[0] for r in df.orderBy("i").select(T.ngrams(F.col("k"), (1, 2))).collect()]
    assert got == [[], ["um"], ["um", "dois", "um dois"],
                   ["um", "dois", "tres", "um", "um dois", "dois tres", "tres um"]]
    triples = [r[0] for r in df.orderBy("i").select(T.ngrams(F.col("k"), (3, 3))).collect()]
    assert triples == [[], [], [], ["um dois tres", "dois tres um"]]
    pairs = [[tuple(p) for p in r[0]] for r in df.orderBy("i").select(T.adjacent(F.col("k"), 2)).collect()]
    assert pairs == [[], [], [("um", "dois")], [("um", "dois"), ("dois", "tres"), ("tres", "um")]]


def test_small_text_helpers(spark):
    texts = ["oi mundo grande", "a bb ccc dddd dddd", "x = 1\n\n  # note\r\n\ty\n#z", "ab"]
    rows = _rows(
        spark, texts,
        long=T.long_words(F.col("t")), parts=T.pieces(F.col("t"), 4), lines=T.code_lines(F.col("t")),
        label=T.short_label(F.col("t"), 6, "oi "), words=T.phrase_words(F.array("t", F.lit("ab oi"))),
    )
    assert [r["long"] for r in rows] == [["mundo", "grande"], ["dddd"], ["note\r\n\ty\n#z"], []]
    assert rows[3]["parts"] is None and rows[0]["parts"][:2] == ["oi m", "i mu"]
    assert [r["lines"] for r in rows] == [1, 1, 2, 1]
    assert [r["label"] for r in rows] == ["mundo ", "a bb c", "x = 1 ", "ab"]
    assert rows[0]["words"] == ["oi", "mundo", "grande", "ab"]


def test_score_label_and_numbers(spark):
    df = spark.createDataFrame(
        [(1, 0.12345, "7"), (2, None, None), (3, float("nan"), "x")], "i int, v double, s string"
    ).orderBy("i")
    rows = df.select(
        T.score_label(F.col("v")).alias("label"), scalars.number_or_zero(F.col("v")).alias("n"),
        scalars.label_or(F.col("s"), "none").alias("s"),
    ).collect()
    assert [r["label"] for r in rows][:2] == ["0.123", "fallback"]
    assert [r["n"] for r in rows] == [0.12345, 0.0, 0.0]
    assert [r["s"] for r in rows] == ["7", "none", "x"]


def test_times(spark):
    texts = ["2024-05-05T23:10:00.123Z", "2024-05-05T23:10:00-03:00", "2024-05-05T23:10:00", "bad", "", None]
    rows = _rows(spark, texts, h=scalars.wall_clock_hour(F.col("t")), at=scalars.event_time(F.col("t")))
    assert [r["h"] for r in rows] == [23, 23, 23, None, None, None]
    assert rows[1]["at"] is not None and rows[3]["at"] is None
    back = spark.sql("select timestamp'2024-01-02 03:04:05.678901' t").select(scalars.iso_utc(F.col("t"))).first()[0]
    assert back == "2024-01-02T03:04:05.678Z"


def test_draws_are_even_and_repeatable(spark):
    df = spark.range(3000).select(scalars.draw_below(F.lit(3), "s", F.col("id")).alias("d"))
    counts = {r["d"]: r["count"] for r in df.groupBy("d").count().collect()}
    assert set(counts) == {0, 1, 2} and min(counts.values()) > 850
    assert df.collect() == df.collect()
