"""Search over a batch of queries: cosine top-k, keyword fallback, and the two in a row.

A batch of queries that meets few postings is scored where they lie. For a larger one the cosine search
scores few of the pairs that share a term. Some documents that hold a query's rarest terms are scored
first; the score of the k-th answer among them is a floor that every hit has to reach. For each block of documents the index knows the
largest weight of every term, and so the most that a term can add there. Terms whose largest additions together
stay below the floor cannot make a hit by themselves, so only documents that hold one of the others become candidates, and only
those whose sum so far, with all that the rest could add, reaches the floor are scored in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestone.functions.text import compose, has_text, long_words, pieces, search_form
from lodestone.operators.rows import one_per_row
from lodestone.operators.sizing import broadcast_limit, lookup_join, on_all_cores, small_enough
from lodestone.plans.index import (
    _CLASS_BITS, _COMPACT, KEY, LENGTH_STEPS, SLICES, TextIndex, bucketed, bucketed_table, in_slice, query_vectors, tops_of, with_terms, within_blocks,
)
from lodestone.plans.product import best_products, one_row_per_document
from lodestone.session import checkpoint_dir, cut_lineage, remove, tidied, written

# Defaults and method labels that results have to carry.
TOP_K = 3
THRESHOLD = 0.05
LONGER_THAN = 3
SEMANTIC = "semantica"
KEYWORD = "palavra_chave"

# Sums of the same products can differ in the last bits with the order of rows.
SCORE_DIGITS = 10
# Bounds are compared with this much to spare.
_SPARE = 1e-9
# Parts that the answers of one token, word or query are dealt to; those of a token are kept as bits of a long.
PARTS = 64
# Bytes of text for one bucket of the index of words, about; its rows take seven times as much in memory.
WORD_BUCKET_BYTES = 16 * 1024 * 1024
# Postings that a batch may meet, for each core, before bounds are worked out first.
PLAIN_ROWS = 10_000_000
# Size of a posting as :func:`measured_bytes` counts.
_POSTING_BYTES = 96
# Rows of a query's rarest terms that are scored for its floor. They only decide how much is passed over.
SEED_ROWS = 200
# The same for each query of a batch that is not broadcast.
WIDE_SEED_ROWS = 50
# A term of a query, in one row with the query's others.
_NESTED_BYTES = 32
# Classes of lengths are LENGTH_STEPS to a factor of two.
_WIDE_BITS = _CLASS_BITS + LENGTH_STEPS.bit_length() - 1


@dataclass(frozen=True)
class Asked:
    """``terms``: query_id, a, b, df, pull, floor, where ``pull`` is what one tf / norm of the term adds to a score and ``floor`` the
    least score asked for. ``bytes``: their measured size. ``small``: whether they, or what has no more rows, are broadcast. ``rows``: how
    many postings they meet in all. ``raised``: whether the floors come from answers found, so that few documents reach them."""

    terms: DataFrame
    bytes: int
    rows: int
    raised: bool = False

    @property
    def small(self) -> bool:
        return self.bytes <= broadcast_limit(self.terms)

    def with_query(self, table: DataFrame, buckets: int) -> DataFrame:
        """Rows of a table laid out by block with all terms of their query; the layout is kept."""
        terms = self.terms.select("query_id", *KEY, "pull")
        if self.small:
            return table.join(F.broadcast(terms), "query_id")
        # in one row for each query the terms take a quarter of the room
        if terms.count() * _NESTED_BYTES <= broadcast_limit(terms):
            nested = terms.groupBy("query_id").agg(F.collect_list(F.struct(*KEY, "pull")).alias("_terms"))
            return table.join(F.broadcast(nested), "query_id").select(*table.columns, F.inline("_terms"))
        return table.join(terms, "query_id").repartition(buckets, "block")

    def with_term(self, table: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
        """Rows of a table laid out by block with what is asked of their term; the layout is kept."""
        met = with_terms(table if self.small else self.sought(table, asked), asked, self.small)
        return met if self.small else met.repartition(buckets, "block")

    def sought(self, table: DataFrame, asked: DataFrame) -> DataFrame:
        """Rows of a table whose term is asked for, where a broadcast holds those terms once each; else all."""
        keys = asked.select(*KEY)
        if not self.small:
            keys = cut_lineage(keys.distinct())
        return with_terms(table, keys, True, "left_semi") if self.small or small_enough(keys) else table


def asked_terms(index: TextIndex, queries: DataFrame, threshold: float = THRESHOLD) -> Asked:
    """The terms of the queries that are not blank, with one floor for all."""
    vectors, size = query_vectors(index, queries.filter(has_text(F.col("text"))))
    pull = (F.col("weight") * F.col("idf")).alias("pull")
    rows = vectors.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    return Asked(vectors.select("query_id", *KEY, "df", pull, F.lit(float(threshold)).alias("floor")), size, rows)


def _added() -> Column:
    return F.sum(F.col("tf") * F.col("pull") / F.col("norm"))


def _rounded(dots: DataFrame) -> DataFrame:
    return dots.select("block", "doc_id", "query_id", F.round("dot", SCORE_DIGITS).alias("score"))


def scored(index: TextIndex, pairs: DataFrame, asked: Asked) -> DataFrame:
    """``block, doc_id, query_id, score`` of the given pairs ``block, doc_id, query_id``, from all their terms."""
    met = within_blocks(index.posts, asked.with_query(pairs, index.n_buckets), ["doc_id", *KEY])
    return _rounded(met.groupBy("block", "doc_id", "query_id").agg(_added().alias("dot")))


def seed_pairs(index: TextIndex, asked: Asked, rows: int | None = None) -> DataFrame:
    """``block, doc_id, query_id``: documents that hold the rarest terms of each query, so many that their rows stay within ``rows``."""
    rows = rows or (SEED_ROWS if asked.small else WIDE_SEED_ROWS)
    upto = F.sum("df").over(W.partitionBy("query_id").orderBy("df", *KEY).rowsBetween(W.unboundedPreceding, 0))
    rarest = asked.terms.select("query_id", *KEY, upto.alias("upto")).filter(F.col("upto") <= rows).drop("upto")
    return asked.with_term(index.posts, rarest, index.n_buckets).select("block", "doc_id", "query_id").distinct()


def with_floors(index: TextIndex, asked: Asked, k: int, copies: bool) -> Asked:
    """The asked terms with the score of the k-th answer among the seeds as floor, where that is higher."""
    if k < 1:
        return asked
    found = scored(index, seed_pairs(index, asked), asked)
    keyed = found.withColumn("key", F.col("doc_id")) if copies else _with_keys(index, found)
    best = keyed.groupBy("query_id", "key").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"))
    kth = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).filter(F.col("rank") == k)
    kth = kth.select("query_id", F.col("score").alias("kth"))
    raised = asked.terms.join(F.broadcast(kth) if asked.small else kth, "query_id", "left")
    raised = raised.withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor"))).drop("kth")
    return Asked(cut_lineage(raised, by_block=True), asked.bytes, asked.rows, True)


def _with_keys(index: TextIndex, pairs: DataFrame) -> DataFrame:
    heads = index.heads.select("block", "doc_id", F.col("dedup_key").alias("key"))
    return pairs.join(heads.hint("shuffle_hash"), ["block", "doc_id"])


def candidate_pairs(index: TextIndex, asked: Asked) -> DataFrame:
    """``block, doc_id, query_id, part, rest, floor``: pairs with a term without which the floor is out of reach.

    In each block a query's terms are passed over, those of the least addition for each of their rows first, as long as their
    largest additions together stay below the floor. ``part`` is the sum over the other terms, ``rest`` the most that those
    passed over can add.
    """
    # only terms that are asked for need a bound
    held = asked.sought(index.posts, asked.terms)
    if not asked.small:
        return _wide_candidates(held, asked)
    bounds = asked.with_term(tops_of(held), asked.terms.drop("df"), index.n_buckets)
    met = within_blocks(index.posts, _needed(bounds, "block").select("block", *KEY, "query_id", "pull", "floor", "rest"), KEY)
    return met.groupBy("block", "doc_id", "query_id").agg(_added().alias("part"), F.max("rest").alias("rest"), F.max("floor").alias("floor"))


def _needed(bounds: DataFrame, where: str) -> DataFrame:
    """The terms of each query, in each place of ``where``, without which its floor is out of reach, and the ``rest`` the others can add."""
    own = W.partitionBy(where, "query_id")
    most = F.col("pull") * F.col("top")
    upto = F.sum("most").over(own.orderBy(F.col("most") / F.col("n"), "a").rowsBetween(W.unboundedPreceding, 0))
    marked = bounds.withColumn("most", most).withColumn("upto", upto).withColumn("needed", F.col("upto") >= F.col("floor") - _SPARE)
    marked = marked.withColumn("rest", F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))).over(own), F.lit(0.0)))
    return marked.filter("needed")


def _wide_candidates(held: DataFrame, asked: Asked) -> DataFrame:
    """The same for a batch too large to be sent to every block: bounds are those of lengths within a factor of two.

    So there are a few bounds for each query and term, however many blocks the index has.
    """
    rows = held.select((F.col("tf") / F.col("norm")).alias("x"), F.shiftright("block", _WIDE_BITS).alias("wide"), "block", "doc_id", *KEY)
    tops = rows.groupBy("wide", *KEY).agg(F.max("x").alias("top"), F.count("*").alias("n"))
    bounds = tops.join(asked.terms.select("query_id", *KEY, "pull", "floor"), KEY)
    needed = _needed(bounds, "wide").select("wide", *KEY, "query_id", "pull", "floor", "rest")
    met = rows.join(needed, ["wide", *KEY])
    part = F.sum(F.col("x") * F.col("pull")).alias("part")
    return met.groupBy("block", "doc_id", "query_id").agg(part, F.max("rest").alias("rest"), F.max("floor").alias("floor"))


def _few(index: TextIndex, asked: Asked) -> bool:
    """Whether the postings that the asked terms meet are fewer than bounds would pay for, or as few as an index that is broadcast has."""
    cores = index.posts.sparkSession.sparkContext.defaultParallelism
    return asked.small and asked.rows <= PLAIN_ROWS * cores or index.n_postings * _POSTING_BYTES <= min(asked.bytes, broadcast_limit(asked.terms))


def score_pairs(index: TextIndex, asked: Asked) -> DataFrame:
    """``block, doc_id, query_id, score`` of every pair that reaches the floor of its query, and of others.

    The same scores in either way. A batch that meets few postings is summed up as it is, where the postings lie. For a larger one, bounds
    tell which pairs to score. With no more than a threshold many pairs reach their floor, and each with all terms of its query is more than the
    postings met; a batch that is broadcast is summed up as it is then, too.
    """
    if not _few(index, asked) and (asked.raised or not asked.small):
        likely = candidate_pairs(index, asked).filter(F.col("part") + F.col("rest") >= F.col("floor") - _SPARE)
        return scored(index, likely.select("block", "doc_id", "query_id"), asked)
    met = asked.with_term(index.posts, asked.terms, index.n_buckets) if asked.small else with_terms(asked.terms, index.posts, True)
    return _rounded(met.groupBy("block", "doc_id", "query_id").agg(_added().alias("dot")))


def best_per_key(pairs: DataFrame, *groups: str) -> DataFrame:
    """Best row of each dedup key (score, then doc_id), combined before any shuffle."""
    best = F.max(F.struct("score", "doc_id"))
    return pairs.groupBy(*groups, "dedup_key").agg(best.alias("b")).select(*groups, "dedup_key", "b.*")


def top_rows(pairs: DataFrame, k: int, *groups: str) -> DataFrame:
    order = W.partitionBy(*groups).orderBy(F.desc("score"), F.desc("doc_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _hits(index: TextIndex, queries: DataFrame, k: int, threshold: float, copies: bool) -> DataFrame:
    """``query_id, dedup_key, doc_id, score`` of the pairs above the threshold that can be among the best k.

    What is among the best k of all is among the best k of its block, so each block sends no more than that. For a batch larger than
    a broadcast each task does so for its documents.
    """
    asked = asked_terms(index, queries, threshold)
    if not asked.small and not _few(index, asked) and k > 0 and one_row_per_document(index):
        return best_products(index, asked.terms, k, threshold, SCORE_DIGITS, copies)
    if not _few(index, asked):
        asked = with_floors(index, asked, k, copies)
    pairs = score_pairs(index, asked).filter(F.col("score") > threshold)
    keyed = pairs.withColumn("dedup_key", F.col("doc_id")) if copies else _with_keys(index, pairs).withColumnRenamed("key", "dedup_key")
    best = keyed if copies else best_per_key(keyed, "block", "query_id")
    best = top_rows(best, k, "block", "query_id").select("query_id", "dedup_key", "doc_id", "score")
    return cut_lineage(best, by_block=True)


def semantic_search(index: TextIndex, queries: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """``query_id, rank, doc_id, dedup_key, similarity``: the k best distinct answers per query.

    Only scores above ``threshold`` count. Copies of one answer are combined before the shuffle.
    """
    pairs = _hits(index, queries, k, threshold, copies=False)
    best = top_rows(best_per_key(pairs, "query_id"), k, "query_id")
    return best.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "dedup_key", F.col("score").alias("similarity")
    )


def best_documents(index: TextIndex, queries: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """``query_id, rank, doc_id, score``: the k best documents per query, those of one answer each by itself."""
    pairs = _hits(index, queries, k, threshold, copies=True)
    return top_rows(pairs, k, "query_id").select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def query_words(queries: DataFrame, longer_than: int = LONGER_THAN) -> DataFrame:
    """``query_id, word`` for the distinct words of more than ``longer_than`` characters."""
    forms = queries.select("query_id", search_form(F.col("text")).alias("form"))
    return one_per_row(forms, ["query_id"], long_words(F.col("form"), longer_than), "word")


@dataclass(frozen=True)
class WordIndex:
    """Where words occur, for search by parts of words.

    ``rows``: token, part, dedup_key, doc_id, bucketed by token and part (a hash of the dedup key, so that a common token is
    many parts). ``pieces``: piece, token, parts, first for every run of ``longer_than + 1`` characters, bucketed by piece; bit i of ``parts``
    tells whether part i has rows of the token, ``first`` is the least ``doc_id`` of the token.
    """

    rows: DataFrame
    pieces: DataFrame
    longer_than: int
    n_buckets: int
    path: str

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        bucketed(self.rows, self.n_buckets, f"{path}/rows", ("token", "part"))
        bucketed(self.pieces, self.n_buckets, f"{path}/pieces", ("piece",))
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        facts = [(self.longer_than, self.n_buckets, kinds["doc_id"], kinds["dedup_key"])]
        spark.createDataFrame(facts, "longer_than int, n_buckets int, id string, key string").write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> WordIndex:
        facts = spark.read.parquet(f"{path}/facts").first()
        columns = f"token STRING, part INT, dedup_key {facts['key']}, doc_id {facts['id']}"
        cut = f"piece STRING, token STRING, parts BIGINT, first {facts['id']}"
        rows = bucketed_table(spark, f"{path}/rows", columns, facts["n_buckets"], ("token", "part"))
        pieces = bucketed_table(spark, f"{path}/pieces", cut, facts["n_buckets"], ("piece",))
        return WordIndex(rows, pieces, facts["longer_than"], facts["n_buckets"], path)

    def drop(self) -> None:
        """Delete the stored tables, once no search reads them any more."""
        remove(self.rows.sparkSession, self.path)


def build_word_index(
    kb: DataFrame, search_cols: Sequence[str], dedup_col: str | Column, longer_than: int = LONGER_THAN, buckets: int | None = None
) -> WordIndex:
    """Index the words of more than ``longer_than`` characters of every row. The text is read for its bytes and once for each slice of the
    rows; the words of a row are made once.

    A query word that occurs in a normalised text lies within one of its tokens, and that token holds the word's first
    ``longer_than + 1`` characters. Unless given, there is a bucket for every ``WORD_BUCKET_BYTES`` of text, and at least one for each
    shuffle partition and three for each core.
    """
    spark = kb.sparkSession
    dedup = F.col(dedup_col) if isinstance(dedup_col, str) else dedup_col
    texts = kb.select("doc_id", dedup.alias("dedup_key"), compose(*[F.col(c) for c in search_cols]).alias("text"))
    part = F.pmod(F.xxhash64("dedup_key"), F.lit(PARTS)).cast("int").alias("part")
    if buckets is None:
        least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        with tidied(texts):
            size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()["b"]
        buckets = max(least, -(-size // WORD_BUCKET_BYTES))
    n = buckets
    path = f"{checkpoint_dir(spark)}/words-{uuid.uuid4().hex}"

    def own(of_slice: DataFrame) -> DataFrame:
        forms = of_slice.select("doc_id", "dedup_key", search_form(F.col("text")).alias("form"))
        rows = one_per_row(forms, ["doc_id", "dedup_key"], long_words(F.col("form"), longer_than), "token")
        return rows.select("token", part, "dedup_key", "doc_id")

    # rows of one document lie together, which takes less room
    held = spark.table(_in_slices(on_all_cores(texts, "doc_id"), "doc_id", own, n, f"{path}/rows", ("token", "part"), ("dedup_key", "doc_id", "token")))

    def cut(of_slice: DataFrame) -> DataFrame:
        seen = of_slice.groupBy("token").agg(F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts"), F.min("doc_id").alias("first"))
        return one_per_row(seen, ["token", "parts", "first"], pieces(F.col("token"), longer_than + 1), "piece").select("piece", "token", "parts", "first")

    found = spark.table(_in_slices(held, "token", cut, n, f"{path}/pieces", ("piece",), ("piece", "token")))
    return WordIndex(held, found, longer_than, n, path)


def _in_slices(
    rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], n: int, path: str, by: Sequence[str], sort: Sequence[str]
) -> str:
    """Send what ``step`` makes of a table to its buckets, a slice of the ``key`` at a time, so that the disk never holds all that is sent."""
    table = None
    for i in range(SLICES):
        laid = step(rows.filter(in_slice(F.col(key), i))).repartition(n, *by)
        table = bucketed(laid, n, path, by, sort, table)
    return table


def _with_last(words: WordIndex, sought: DataFrame, k: int, copies: bool) -> DataFrame:
    """Words that are broadcast, with ``last``: a ``doc_id`` up to which k answers lie, if the word is a token of so many rows.

    Each part of the token sends a few rows, which are answers of their own; the k-th of them bounds the k-th of all.
    """
    each = 2 * -(-k // PARTS)
    own = words.rows.join(F.broadcast(sought.select(F.col("word").alias("token"))), "token", "left_semi")
    if copies:
        own = own.withColumn("dedup_key", F.col("doc_id"))
    ids = _first_of_parts(own, each, "token", "part").groupBy(F.col("token").alias("word")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    return sought.join(F.broadcast(cut_lineage(ids.select("word", F.get("ids", F.lit(k - 1)).alias("last")))), "word", "left")


def tokens_with_words(words: WordIndex, asked: DataFrame, k: int, copies: bool) -> DataFrame:
    """``token, parts, word, last`` for every asked word inside a token of the table that can have one of the word's first k answers.

    Words and tokens meet in an equality join on the word's first characters, and ``contains`` settles the rest. A token
    whose first row comes after ``last`` is left out.
    """
    sought = cut_lineage(asked.select("word").distinct())
    small = small_enough(sought)
    # rows without an id come first, whatever the bound
    if small and k > 0 and words.rows.filter(F.col("doc_id").isNull()).isEmpty():
        sought = _with_last(words, sought, k, copies)
    else:
        sought = sought.withColumn("last", F.lit(None).cast(words.rows.schema["doc_id"].dataType))
    sought = sought.withColumn("piece", F.substring("word", 1, words.longer_than + 1))
    if small:
        found = words.pieces.join(F.broadcast(sought), "piece")
    else:
        found = lookup_join(words.pieces, cut_lineage(sought), ["piece"], "inner", ["token"])
    found = found.filter(F.contains(F.col("token"), F.col("word")) & (F.col("last").isNull() | (F.col("first") <= F.col("last"))))
    return written(found.select("token", "parts", "word", "last"), _COMPACT)[0]


def _least_ranks(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    """The k rows of each group with the least ``doc_id``, and their ``rank``."""
    order = W.partitionBy(*groups).orderBy("doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _first_of_parts(rows: DataFrame, k: int, group: str, part: str) -> DataFrame:
    """The k keys of each part of a group that come first in the table, each at its first row."""
    return _least_ranks(rows.groupBy(group, part, "dedup_key").agg(F.min("doc_id").alias("doc_id")), k, group, part)


def _first_rows(rows: DataFrame, k: int, group: str, part: str = "_part") -> DataFrame:
    """The k keys of each group that come first in the table, each at its first row.

    Keys are dealt to parts by their hash and each part keeps its own k, so a group of any
    size is cut up at any k, and at most ``k * PARTS`` rows of it meet in one task.
    """
    if part not in rows.columns:  # laid out by part at once, so that counting and ranking need no exchange of their own
        rows = rows.withColumn(part, F.pmod(F.xxhash64("dedup_key"), F.lit(PARTS))).repartition(group, part)
    return _least_ranks(_first_of_parts(rows, k, group, part), k, group).drop(part)


def _first_of_tokens(words: WordIndex, matched: DataFrame, k: int, copies: bool) -> DataFrame:
    """``token, dedup_key, doc_id``: the k keys of each matched token that come first, each at its first row.

    The rows of the index stay where they are stored. The parts in which a token has rows are sent to them, and each sends its first k up
    to the ``last`` of a word.
    """
    present = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.getbit(F.col("parts"), i) == 1)
    sought = matched.select(F.col("token").alias("_token"), F.explode(present).alias("_part"), "last")
    sought = F.broadcast(sought) if small_enough(sought) else sought.hint("shuffle_hash")
    rows = words.rows.select("token", "part", "doc_id", F.col("doc_id").alias("dedup_key")) if copies else words.rows
    own = (F.col("token") == F.col("_token")) & (F.col("part") == F.col("_part")) & (F.col("last").isNull() | (F.col("doc_id") <= F.col("last")))
    first = _first_of_parts(rows.join(sought, own, "left_semi"), k, "token", "part")
    # a document that comes twice can be in two parts
    met = first.repartition("token").groupBy("token", "dedup_key").agg(F.min("doc_id").alias("doc_id"))
    return _least_ranks(met, k, "token").drop("rank")


def keyword_search(words: WordIndex, queries: DataFrame, k: int = TOP_K, copies: bool = False) -> DataFrame:
    """First k distinct answers, in table order, whose text holds a word of the query; with ``copies`` the first k rows.

    An answer among the first k of a query is among the first k of the word it was found
    by, and among the first k of the token that holds this word. So k rows are kept per
    token, then per word, then per query, and no query is paired with all its matches. No text is read, only
    the rows of tokens that hold a word.
    """
    asked = cut_lineage(query_words(queries, words.longer_than))
    matched = tokens_with_words(words, asked, k, copies)
    # a token has at most k rows here, and as many words as lie within it
    met = matched.select("token", "word").join(_first_of_tokens(words, matched, k, copies), "token")
    per_word = _first_rows(met, k, "word").drop("rank")
    found = per_word.join(F.broadcast(asked), "word") if small_enough(asked) else lookup_join(asked, cut_lineage(per_word), ["word"], "inner", ["query_id"])
    return _first_rows(found, k, "query_id").select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "doc_id",
        "dedup_key",
        F.lit(None).cast("double").alias("similarity"),
    )


def without_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def cascade_search(
    index: TextIndex, words: WordIndex, queries: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD
) -> DataFrame:
    """Cosine hits; for queries without any, keyword hits. Adds the column ``method``."""
    # at most k rows per query
    hits = cut_lineage(semantic_search(index, queries, k, threshold)).withColumn("method", F.lit(SEMANTIC))
    rest = cut_lineage(without_hits(queries.filter(has_text(F.col("text"))), hits))
    if rest.isEmpty():
        return hits
    return hits.unionByName(keyword_search(words, rest, k).withColumn("method", F.lit(KEYWORD)))


def search_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query: method, number of hits and the hits in rank order.

    A query with no hit at all was last tried by keyword, and carries that label.
    """
    grouped = hits.groupBy("query_id").agg(
        F.max("method").alias("method"),
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "similarity"))).alias("hits"),
    )
    return queries.select("query_id").join(grouped, "query_id", "left").select(
        "query_id",
        F.coalesce("method", F.lit(KEYWORD)).alias("method"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hits"),
        "hits",
    )


def with_rows(hits: DataFrame, kb: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fetch the table row of each hit, after the top-k."""
    hits = cut_lineage(hits)  # at most k rows per query, and read twice below
    wanted = hits.select("doc_id").distinct()
    rows = kb.select("doc_id", *columns)
    if small_enough(wanted):
        wanted = F.broadcast(wanted)
    rows = cut_lineage(rows.join(wanted, "doc_id", "left_semi"))
    return lookup_join(hits, rows, ["doc_id"], "inner", ["query_id", "rank"])
