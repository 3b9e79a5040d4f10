import math
import pathlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import DATA
from lodestone.catalog import views
from lodestone.operators.sizing import BROADCAST_CONF
from lodestone.plans import index as ix, search as S
from lodestone.plans.index import TextIndex, build_index, corpus_terms, index_shape
from lodestone.session import checkpoint_dir

WORDS = "casa rede wifi senha cabo mesa conta login lento erro tela impressora roteador cartao porta b 7".split()


def _terms(text, span=(1, 2)):
    toks = [w for w in text.lower().split() if len(w) >= 2]
    return [" ".join(toks[i : i + n]) for n in range(span[0], span[1] + 1) for i in range(len(toks) - n + 1)]


class Brute:
    """Plain TF-IDF over a list of texts."""

    def __init__(self, texts, span=(1, 2), cap=2000):
        self.span, bags = span, [Counter(_terms(t, span)) for t in texts]
        total = Counter()
        for bag in bags:
            total.update(bag)
        self.vocab = {t: c for t, c in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:cap]}
        n = len(texts)
        df = Counter(t for bag in bags for t in bag)
        self.idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in self.vocab}
        self.docs = [self.vector(bag) for bag in bags]

    def vector(self, bag):
        raw = {t: c * self.idf[t] for t, c in bag.items() if t in self.vocab}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    def search(self, text, keys, k=3, threshold=0.05):
        q = self.vector(Counter(_terms(text, self.span)))
        scored = sorted(
            ((round(sum(w * d.get(t, 0) for t, w in q.items()), 10), i) for i, d in enumerate(self.docs)), reverse=True
        )
        hits, seen = [], set()
        for score, i in scored:
            if score <= threshold or len(hits) >= k:
                break
            if keys[i] not in seen:
                seen.add(keys[i])
                hits.append((i, score))
        return hits


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 14))) for _ in range(90)]
    return made + ["rede wifi senha lento"] * 45  # a third of all rows is one text


@pytest.fixture(scope="module")
def kb(spark, texts):
    rows = [(i, f"c{i % 4}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, category string, rule string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(8)
    made = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 6))) for _ in range(25)]
    made += ["", "   ", "zzz qqqq", "impress", "rede wifi senha lento", "otead"]
    return spark.createDataFrame(list(enumerate(made)), "query_id long, text string").cache()


@pytest.fixture(scope="module")
def index(kb):
    return build_index(kb, ["rule"], "rule", buckets=6)


@pytest.mark.parametrize("span", [(1, 1), (1, 2), (1, 3), (2, 2)])
@pytest.mark.parametrize("cap", [5, 16, 17, 18, 40, 2000])
def test_vocabulary_cap_is_exact(kb, texts, span, cap):
    got = {r["term"]: r["tf"] for r in corpus_terms(kb.select(F.col("rule").alias("text")), span, cap).collect()}
    assert got == Brute(texts, span, cap).vocab


def test_tied_words_outside_the_cap_still_form_bigrams(spark):
    # zz is cut by its name, yet "aa zz" ties with it and sorts before "mm"
    rows = [("aa zz",), ("mm",), ("aa zz",), ("mm",)]
    texts = spark.createDataFrame(rows, "text string")
    assert sorted(r["term"] for r in corpus_terms(texts, (1, 2), 2).collect()) == ["aa", "aa zz"]


def test_uncapped_vocabulary(kb, texts):
    got = {r["term"]: r["tf"] for r in corpus_terms(kb.select(F.col("rule").alias("text")), (1, 2), None).collect()}
    assert got == Brute(texts, cap=10**9).vocab


@pytest.mark.parametrize("cap", [25, 2000, None])
def test_weights(kb, texts, cap):
    index = build_index(kb, ["rule"], "rule", max_features=cap, buckets=3)
    want = Brute(texts, cap=cap or 10**9)
    got = {}
    for r in index.postings().collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    assert got == {i: pytest.approx(d) for i, d in enumerate(want.docs) if d}
    shape = index_shape(index).first()
    assert (shape["n_docs"], shape["n_terms"]) == (len(texts), len(want.vocab))


@pytest.mark.parametrize("broadcast", [-1, 480])
def test_weights_of_rare_terms_that_meet_at_their_term(spark, kb, texts, broadcast):
    """No or ten frequent terms are sent around; all others are counted where they meet."""
    spark.conf.set(BROADCAST_CONF, str(broadcast))
    try:
        index = build_index(kb, ["rule"], "rule", buckets=3)
        rows = index.postings().collect()
    finally:
        spark.conf.unset(BROADCAST_CONF)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    assert got == {i: pytest.approx(d) for i, d in enumerate(Brute(texts, cap=10**9).docs) if d}
    counts = {(r["doc_id"], r["term"]): r["tf"] for r in index.postings(weights=False).collect()}
    assert counts == {(i, t): c for i, text in enumerate(texts) for t, c in Counter(_terms(text)).items()}


def test_index_takes_little_more_room_than_its_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(4000)]
    texts = [" ".join(words[min(int(rng.paretovariate(0.7)), 3999)] for _ in range(300)) for _ in range(1500)]
    kb = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, rule string")
    index = build_index(kb, ["rule"], F.md5("rule"), buckets=4)
    folder = pathlib.Path(index.path.removeprefix("file:"))
    assert sum(f.stat().st_size for f in folder.rglob("*.parquet")) < 2 * sum(map(len, texts))


def _by_query(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["similarity"]))
    return out


@pytest.fixture
def bounded(monkeypatch):
    """Every batch goes by bounds."""
    monkeypatch.setattr(S, "PLAIN_ROWS", -1)
    monkeypatch.setattr(S, "_POSTING_BYTES", 1 << 40)


@pytest.mark.parametrize("bounds", [True, False])
@pytest.mark.parametrize("k,threshold", [(3, 0.05), (1, 0.05), (5, 0.3), (200, 0.0), (0, 0.05)])
def test_semantic_search(request, index, asked, texts, k, threshold, bounds):
    if bounds:
        request.getfixturevalue("bounded")
    want, brute = {}, Brute(texts)
    for r in asked.collect():
        hits = brute.search(r["text"], texts, k, threshold)
        if hits:
            want[r["query_id"]] = hits
    got = _by_query(S.semantic_search(index, asked, k, threshold))
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits], abs=1e-9)


def test_large_batches_give_the_same(spark, index, asked, bounded):
    want = _by_query(S.semantic_search(index, asked, 4))
    spark.conf.set(BROADCAST_CONF, "-1")
    try:
        assert not S.asked_terms(index, asked).small
        assert _by_query(S.semantic_search(index, asked, 4)) == want
    finally:
        spark.conf.unset(BROADCAST_CONF)


def test_bounds_of_large_batches_do_not_grow_with_the_blocks(spark, index, asked, bounded):
    spark.conf.set(BROADCAST_CONF, "-1")
    try:
        plan = S.candidate_pairs(index, S.asked_terms(index, asked))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(BROADCAST_CONF)
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("wide#" in line and "block#" not in line for line in windows)


def test_more_questions_than_postings(index, asked, texts, monkeypatch):
    want = _by_query(S.semantic_search(index, asked, 4))
    monkeypatch.setattr(S, "PLAIN_ROWS", -1)
    monkeypatch.setattr(S, "_POSTING_BYTES", 0)
    terms = S.asked_terms(index, asked)
    assert "BroadcastHashJoin" in S.score_pairs(index, terms)._jdf.queryExecution().executedPlan().toString()
    assert _by_query(S.semantic_search(index, asked, 4)) == want


def test_scores_of_all_pairs_above_the_threshold(index, asked, texts, bounded):
    brute, found = Brute(texts), {}
    for r in S.score_pairs(index, S.asked_terms(index, asked, 0.3)).filter("score > 0.3").collect():
        found[r["query_id"], r["doc_id"]] = r["score"]
    want = {}
    for r in asked.collect():
        want |= {(r["query_id"], i): s for i, s in brute.search(r["text"], range(len(texts)), 10**9, 0.3)}
    assert found == pytest.approx(want, abs=1e-9) and len(found) > 100


def _pairs_formed(index, asked):
    return S.seed_pairs(index, asked).count() + S.candidate_pairs(index, S.with_floors(index, asked, 3, False)).count()


def test_few_of_the_pairs_are_formed(spark, bounded):
    """Long texts of common words, each with a few rare ones; a query asks for both."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join([*rng.choices(common, k=rng.randrange(5, 60)), *(f"r{rng.randrange(900)}" for _ in range(8))]) for _ in range(1200)]
    kb = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, rule string")
    index = build_index(kb, ["rule"], "rule", span=(1, 1), buckets=4)
    made = [" ".join([*rng.choices(common, k=6), *t.split()[-5:]]) for t in rng.sample(texts, 30)]
    queries = spark.createDataFrame(list(enumerate(made)), "query_id long, text string")
    asked = S.asked_terms(index, queries)
    all_pairs = asked.terms.join(index.posts, ["a", "b"]).select("query_id", "doc_id").distinct().count()
    assert _pairs_formed(index, asked) < all_pairs / 3
    brute = Brute(texts, (1, 1), 10**9)
    got = _by_query(S.semantic_search(index, queries))
    for q, text in enumerate(made):
        assert got[q] == [(i, pytest.approx(s, abs=1e-9)) for i, s in brute.search(text, texts)]


def test_pairs_formed_over_the_given_tables(spark):
    if not (DATA / "sf0.1").exists():
        pytest.skip("the given tables are not here")
    index = views.index_of(spark, str(DATA / "sf0.1"))
    asked = S.asked_terms(index, views.questions(spark, str(DATA / "sf0.1")))
    # 1.5 million of the 2 million pairs share a term
    assert _pairs_formed(index, asked) < 143_000


@pytest.mark.parametrize("plain", [10**9, -1])
def test_search_moves_no_postings(index, asked, bounded, monkeypatch, plain):
    monkeypatch.setattr(S, "PLAIN_ROWS", plain)
    terms = S.asked_terms(index, asked)
    plan = S.score_pairs(index, terms)._jdf.queryExecution().executedPlan().toString()
    # tables by block meet as they are stored; only what is asked is sent around
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_index_is_built_with_one_exchange_of_postings(spark, kb, monkeypatch):
    plans = []
    real = ix.bucketed

    def kept(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args)

    monkeypatch.setattr(ix, "bucketed", kept)
    build_index(kb, ["rule"], "rule", buckets=3)
    posts, heads, tops = plans
    assert "Exchange" not in tops
    by_row = [line for line in posts.splitlines() if "Exchange hashpartitioning(block" in line and "REPARTITION" in line]
    # the rows with their terms (again for the terms of each block: the same exchange); the terms that come back do so if they left
    assert len(by_row) in (2, 3) and posts.count("Exchange hashpartitioning(term") == 0
    # nothing is joined by the text of a term
    assert not any("Join" in line and "term" in line for line in posts.splitlines())


def _shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (held.apply(i).getName() for i in range(held.size()))
    return {name for name in names if name.startswith("shuffle_")}


def _left(spark, before):
    """Shuffle files that were not there before; they are deleted in the background."""
    for _ in range(20):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    return left


def test_building_leaves_no_shuffle_files_and_counts_rows_once_on_disk(spark, kb, monkeypatch):
    tables = lambda: set(pathlib.Path(checkpoint_dir(spark).removeprefix("file:")).glob("table-*"))
    before, known, real, seen = _shuffle_files(spark), tables(), ix.bucketed, []

    def kept(df, *args):
        seen.append(tables() - known)
        return real(df, *args)

    monkeypatch.setattr(ix, "bucketed", kept)
    build_index(kb, ["rule"], "rule", buckets=3)
    assert len(seen[0]) == 1  # the norms alone, when the rows' terms are written by block
    assert not tables() - known
    assert not _left(spark, before)


def test_building_the_index_of_words_leaves_no_shuffle_files(spark, kb, monkeypatch):
    before, rows, real = _shuffle_files(spark), [], S.bucketed

    def kept(df, *args):
        rows.append(df.count())
        return real(df, *args)

    words = S.build_word_index(kb, ["category", "rule"], "rule")
    assert not _left(spark, before)
    monkeypatch.setattr(S, "bucketed", kept)
    again = S.build_word_index(kb, ["category", "rule"], "rule")
    # no exchange holds all rows, and none of them is lost
    assert max(rows[: len(rows) // 2]) < sum(rows[: len(rows) // 2]) == words.rows.count() == again.rows.count()
    assert sum(rows[len(rows) // 2 :]) == words.pieces.count()


def test_saved_index_searches_the_same(spark, index, asked, tmp_path):
    index.save(str(tmp_path / "ix"))
    again = TextIndex.load(spark, str(tmp_path / "ix"))
    assert again.n_docs == index.n_docs
    for frame in (again.posts.groupBy("block", "doc_id").count(), again.posts.join(again.tops.hint("shuffle_hash"), ["block", "a", "b"])):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert _by_query(S.semantic_search(again, asked)) == _by_query(S.semantic_search(index, asked))


def _keyword_brute(texts, query, k):
    words = {w for w in query.split() if len(w) > 3}
    hits, seen = [], set()
    for i, t in enumerate(texts):
        if any(w in f"c{i % 4} {t}" for w in words) and t not in seen and len(hits) < k:
            seen.add(t)
            hits.append(i)
    return hits


@pytest.mark.parametrize("k", [0, 1, 3, 500])
@pytest.mark.parametrize("fits", [True, False])
def test_keyword_search(spark, kb, asked, texts, k, fits):
    if not fits:
        spark.conf.set(BROADCAST_CONF, "-1")
    try:
        got = _by_query(S.keyword_search(S.build_word_index(kb, ["category", "rule"], "rule"), asked, k))
    finally:
        spark.conf.unset(BROADCAST_CONF)
    want = {r["query_id"]: _keyword_brute(texts, r["text"], k) for r in asked.collect()}
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {q: h for q, h in want.items() if h}


def test_saved_words_search_the_same_and_read_no_text(spark, kb, asked, tmp_path):
    words = S.build_word_index(kb, ["category", "rule"], "rule")
    words.save(str(tmp_path / "words"))
    again = S.WordIndex.load(spark, str(tmp_path / "words"))
    got = S.keyword_search(again, asked)
    assert _by_query(got) == _by_query(S.keyword_search(words, asked))
    part = S._first_rows(again.rows, 3, "token", "part")._jdf.queryExecution().executedPlan().toString()
    assert part.count("Exchange") == 1  # from the parts of a token to the token
    words.drop()
    assert _by_query(S.keyword_search(again, asked)).keys()


def test_keyword_search_past_a_run_of_copies(spark):
    texts = ["rede lenta"] * 30 + ["rede nova", "rede lenta hoje", "outra rede"]
    kb = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "doc_id long, category string, rule string")
    asked = spark.createDataFrame([(1, "rede"), (2, "nova")], "query_id long, text string")
    hits = _by_query(S.keyword_search(S.build_word_index(kb, ["category", "rule"], "rule"), asked, 3))
    assert {q: [i for i, _ in h] for q, h in hits.items()} == {1: [0, 30, 31], 2: [30]}


def test_a_hot_token_is_cut_up_at_any_k(spark):
    # every row holds the token, and each is a rule of its own
    texts = [f"rede {i}" for i in range(3000)]
    kb = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "doc_id long, category string, rule string")
    asked = spark.createDataFrame([(1, "rede")], "query_id long, text string")
    words = S.build_word_index(kb, ["category", "rule"], "rule")
    for k in (500, 2000):
        hits = S.keyword_search(words, asked, k)
        assert [i for i, _ in _by_query(hits)[1]] == list(range(k))
    rows = kb.select("doc_id", F.col("rule").alias("dedup_key"), F.col("category").alias("token"))
    plan = S._first_rows(rows, 2000, "token")._jdf.queryExecution().optimizedPlan().toString()
    # the rows of a token are ranked by part before they are ranked together
    together, by_part = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert "_part#" in by_part and "_part#" not in together


def test_best_documents_keep_copies(index, asked, texts):
    row = asked.filter("text = 'rede wifi senha lento'").first()
    best = S.best_documents(index, asked.filter(F.col("query_id") == row["query_id"]), 50)
    got = [r["doc_id"] for r in best.orderBy("rank").collect()]
    copies = [i for i, t in enumerate(texts) if t == row["text"]]
    assert got[: len(copies)] == copies[::-1] and len(got) == 50


def test_keyword_plan_has_no_pairwise_join(kb, asked):
    plan = S.keyword_search(S.build_word_index(kb, ["category", "rule"], "rule"), asked)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cascade(kb, index, asked, texts):
    hits = S.cascade_search(index, S.build_word_index(kb, ["category", "rule"], "rule"), asked)
    answers = {r["query_id"]: r for r in S.search_answers(asked, hits).collect()}
    assert len(answers) == asked.count()
    by_text = {r["text"]: answers[r["query_id"]] for r in asked.collect()}
    assert (by_text["zzz qqqq"]["method"], by_text["zzz qqqq"]["n_hits"]) == ("palavra_chave", 0)
    assert by_text["impress"]["method"] == "palavra_chave" and by_text["impress"]["n_hits"] == 3
    assert by_text["rede wifi senha lento"]["method"] == "semantica"
    assert all(h["similarity"] is None for h in by_text["otead"]["hits"])


def test_hit_rows_on_both_paths(spark, kb, index, asked):
    hits = S.semantic_search(index, asked)
    want = sorted(map(tuple, S.with_rows(hits, kb, ["rule"]).select("query_id", "rank", "rule").collect()))
    assert len(want) == hits.count()
    spark.conf.set(BROADCAST_CONF, "-1")
    try:
        assert sorted(map(tuple, S.with_rows(hits, kb, ["rule"]).select("query_id", "rank", "rule").collect())) == want
    finally:
        spark.conf.unset(BROADCAST_CONF)


def _exchanges(monkeypatch, run):
    """The plans of what a search keeps while it runs, and of its result."""
    plans = []
    real = S.written

    def kept(df, *args):
        plans.append(df)
        return real(df, *args)

    monkeypatch.setattr(S, "written", kept)
    plans.append(run())
    return [df._jdf.queryExecution().executedPlan().toString() for df in plans]


@pytest.mark.parametrize("copies", [False, True])
def test_rows_of_the_word_index_are_not_sent_to_their_tokens(spark, kb, asked, monkeypatch, copies):
    """What is sent are a token's parts; the stored rows meet them as they lie."""
    words = S.build_word_index(kb, ["category", "rule"], "rule")
    spark.conf.set(BROADCAST_CONF, "-1")
    try:
        plans = _exchanges(monkeypatch, lambda: S._first_of_tokens(words, S.tokens_with_words(words, S.query_words(asked), 3, copies), 3, copies))
    finally:
        spark.conf.unset(BROADCAST_CONF)
    assert plans[-1].count("Exchange hashpartitioning(_token") == 1 and plans[-1].count("Exchange hashpartitioning(token") == 1


def test_tokens_after_the_first_answers_are_left_out(spark):
    # every row has a token of its own that holds the word, and the word itself
    texts = [f"rede rede{i:04}" for i in range(2000)]
    kb = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "doc_id long, category string, rule string")
    asked = spark.createDataFrame([(1, "rede"), (2, "rede1999")], "query_id long, text string")
    words = S.build_word_index(kb, ["category", "rule"], "rule")
    for k, copies in ((3, False), (500, True)):
        matched = S.tokens_with_words(words, S.query_words(asked), k, copies)
        assert matched.filter("word = 'rede'").count() < 2000 / 2
        hits = _by_query(S.keyword_search(words, asked, k, copies))
        assert {q: [i for i, _ in h] for q, h in hits.items()} == {1: list(range(k)), 2: [1999]}


def test_answers_of_rows_without_an_id_come_first(spark):
    kb = spark.createDataFrame([(None, "c", "parede"), *((i, "c", f"rede {i}") for i in range(300))], "doc_id long, category string, rule string")
    asked = spark.createDataFrame([(1, "rede")], "query_id long, text string")
    hits = _by_query(S.keyword_search(S.build_word_index(kb, ["category", "rule"], "rule"), asked, 3))
    assert [i for i, _ in hits[1]] == [None, 0, 1]


def test_buckets_of_words_grow_with_the_text(spark, kb, monkeypatch):
    least = S.build_word_index(kb, ["category", "rule"], "rule").n_buckets
    monkeypatch.setattr(S, "WORD_BUCKET_BYTES", 16)
    assert S.build_word_index(kb, ["category", "rule"], "rule").n_buckets > 2 * least


def test_terms_outside_a_small_vocabulary_are_not_kept(spark, monkeypatch):
    kb = spark.createDataFrame([(0, "rede wifi"), (1, "senha lenta")], "doc_id long, rule string")
    index = build_index(kb, ["rule"], "rule", buckets=2)
    long = " ".join(f"w{i}" for i in range(500))
    queries = spark.createDataFrame([(1, f"{long} rede wifi"), (2, long)], "query_id long, text string")
    kept, real = [], ix.cut_lineage
    monkeypatch.setattr(ix, "cut_lineage", lambda df, *a, **b: kept.append(real(df, *a, **b)) or kept[-1])
    vectors, _ = ix.query_vectors(index, queries)
    assert vectors.count() == 3 and max(df.count() for df in kept) == 3


@pytest.mark.parametrize("copies", [False, True])
def test_a_batch_past_a_broadcast_is_multiplied_in_tasks(spark, index, asked, texts, monkeypatch, copies):
    """No pair of a query and a document leaves its task but for the best k, and slices of the batch give what the whole does."""
    from lodestone.plans import product

    search = (lambda *a: S.best_documents(*a).withColumnRenamed("score", "similarity")) if copies else S.semantic_search
    want = _by_query(search(index, asked, 2, 0.2))
    monkeypatch.setattr(product, "LEAST_SLICE", 2000)
    monkeypatch.setattr(product._Best, "__init__", _early(product._Best.__init__))
    monkeypatch.setattr(S, "candidate_pairs", None)
    spark.conf.set(BROADCAST_CONF, "-1")
    try:
        monkeypatch.setattr(S, "_few", lambda *_: False)
        got = search(index, asked, 2, 0.2)
        assert _by_query(got) == {q: [(i, pytest.approx(s, abs=1e-9)) for i, s in hits] for q, hits in want.items()}
    finally:
        spark.conf.unset(BROADCAST_CONF)


def _early(start):
    """The best are settled after every few answers."""

    def started(self, *args):
        start(self, *args)
        self.most = 1

    return started


def test_halves_of_keys_may_be_equal():
    import numpy as np
    import pyarrow as pa

    from lodestone.plans.product import _met

    lists = lambda x: pa.array(x, pa.list_(pa.int64()))
    frame = pa.RecordBatch.from_pydict(
        {"doc_id": [7, 8], "dedup_key": ["x", "y"], "norm": [2.0, 1.0], "a": lists([[5, 5, 9], [1]]), "b": lists([[2, 1, 3], [1]]), "tf": lists([[2, 4, 6], [1]])}
    )
    ((doc, key, at, x),) = _met(frame, np.array([3, 5, 5]), np.array([0, 1, 2]))
    assert (doc, key, sorted(zip(at.tolist(), x.tolist()))) == (7, "x", [(1, 2.0), (2, 1.0)])


def test_a_threshold_alone_pairs_nothing_with_all_terms(index, asked, texts, bounded):
    """Its pairs are many; a hash table of each with every term of its query outgrows a task."""
    terms = S.asked_terms(index, asked)
    pairs = S.score_pairs(index, terms)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and "Exchange hashpartitioning" not in plan
    brute, counts = Brute(texts), dict(map(tuple, pairs.filter(F.col("score") > S.THRESHOLD).groupBy("query_id").count().collect()))
    want = {r["query_id"]: len(brute.search(r["text"], range(len(texts)), 10**9, S.THRESHOLD)) for r in asked.collect()}
    assert counts == {q: n for q, n in want.items() if n}
    # floors from answers found keep their bounds
    raised = S.score_pairs(index, S.with_floors(index, terms, 3, False))
    assert "ShuffledHashJoin" in raised._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k,threshold", [(1, 0.05), (3, 0.05), (3, 0.0), (50, 0.2)])
def test_a_large_batch_sums_up_few_pairs(monkeypatch, k, threshold):
    """Common terms alone cannot reach the best answers so far, so what shares no other term is passed over; floors found before pass over more."""
    import numpy as np
    import pyarrow as pa

    from lodestone.plans import product as P

    monkeypatch.setattr(P, "_GROUP", 16)
    monkeypatch.setattr(P, "_STEP", 500)
    rng = np.random.default_rng(7)
    n_docs, n_queries, n_terms = 600, 300, 900
    idf = np.r_[np.full(20, 1.1), np.full(n_terms - 20, 6.0)]
    some = lambda common, rare: np.unique(np.r_[rng.integers(0, 20, common), rng.integers(20, n_terms, rare)])
    scaled = lambda t: idf[t] ** 2 / np.sqrt((idf[t] ** 2).sum())
    docs = [(t, 1 / np.sqrt((idf[t] ** 2).sum())) for t in (some(15, rng.integers(2, 40)) for _ in range(n_docs))]
    asked = [(t, scaled(t)) for t in (some(8, 3) for _ in range(n_queries))]
    keys = rng.integers(-(2**62), 2**62, n_terms)
    df = np.bincount(np.concatenate([t for t, _ in docs]), minlength=n_terms)
    flat = np.concatenate([t for t, _ in asked])
    rows = {"query_id": np.repeat(np.arange(n_queries), [len(t) for t, _ in asked]), "a": keys[flat], "b": keys[flat], "df": df[flat], "pull": np.concatenate([p for _, p in asked])}
    queries = P._by_query(pa.table(rows), threshold)
    of = [(t[np.isin(keys[t], queries.first)], x) for t, x in docs]
    held = [(i, i // 2, np.searchsorted(queries.first, keys[t]), np.full(len(t), x)) for i, (t, x) in enumerate(of)]

    dense = np.zeros((n_queries, n_docs))
    for i, (t, p) in enumerate(asked):
        pulls = np.zeros(n_terms)
        pulls[t] = p
        dense[i] = [x * pulls[d].sum() for d, x in docs]
    want = {}
    for i, row in enumerate(np.round(dense, 10)):
        best = {}
        for d in np.flatnonzero(row > threshold):
            best[d // 2] = max(best.get(d // 2, (0, 0)), (row[d], d))
        want[i] = sorted(best.values(), reverse=True)[:k]

    summed, real = [], P._Best.add
    monkeypatch.setattr(P._Best, "add", lambda self, q, dots, doc: summed.append(len(q)) or real(self, q, dots, doc))
    for most in (1, 10**9):
        best = P._Best(n_queries, k, threshold, 10)
        best.most, best.low = most, queries.floors - P._SPARE
        P._multiply(queries, held, best)
        got = {i: [] for i in range(n_queries)}
        for q, score, doc in sorted(zip(*best.settle()), key=lambda r: (r[0], -r[1], -best.ids[r[2]])):
            got[queries.ids[q].as_py()].append((pytest.approx(score, abs=1e-9), best.ids[doc]))
        assert got == want
        if most == 1 and k < 50:
            shared = sum((dense[i] > 0).sum() for i in range(n_queries))
            assert sum(summed) < shared / 3


@pytest.mark.parametrize("span", [(1, 2), (1, 1), (2, 3), (1, 9)])
@pytest.mark.parametrize("slices", [1, 4])
def test_terms_of_rows_by_slice(span, slices):
    """Counted as plain Python counts them, in order, each term in one slice whatever rows it is met with."""
    import collections

    import pyarrow as pa

    rng, where = random.Random(1), {}
    lines = [" ".join(rng.choice(["ab", "abc", "abc1", "f1", "zz", "z0", "k" * 40]) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(200)]
    for some in (lines, lines[100:], ["", ""], []):
        bags = ix._bags(pa.array(some, pa.string()), span, slices)
        for i, line in enumerate(some):
            w, held = line.split(), [[d["term"] for d in b[i].as_py()] for b in bags]
            want = collections.Counter(" ".join(w[j : j + n]) for n in range(span[0], span[1] + 1) for j in range(len(w) - n + 1))
            assert dict((d["term"], d["tf"]) for b in bags for d in b[i].as_py()) == want and sum(map(len, held)) == len(want)
            assert all(terms == sorted(terms) for terms in held)
            assert all(where.setdefault(term, s) == s for s, terms in enumerate(held) for term in terms)
    assert set(where.values()) == set(range(slices))


def test_terms_are_counted_a_slice_of_columns_at_a_time(spark, kb, monkeypatch):
    """No slice of the terms reads the others, and no term is counted in Spark's own row-by-row functions."""
    plans, real = [], ix.tidied
    monkeypatch.setattr(ix, "tidied", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    built = build_index(kb, ["rule"], "rule", buckets=3)
    vocab = [p for p in plans if "bag" in p and "term" in p and "MapInArrow" not in p]
    assert len(vocab) == ix.SLICES
    for i, plan in enumerate(vocab):
        assert [f"bag{j}" in plan for j in range(ix.SLICES)] == [j == i for j in range(ix.SLICES)]
    assert built.words.count() == built.words.distinct().count()
