"""TF-IDF index as tables: count terms per document, weigh them, turn queries into vectors.

Weights follow the usual smoothed form: tf * (ln((1 + n) / (1 + df)) + 1), rows scaled to
length 1. The vocabulary holds all terms, or if asked the ``max_features`` with the largest corpus count.

A row's terms are counted within the row (numpy and Arrow in tasks) and stored beside it, sorted, as text: that takes a fifth of what keys made
of hashes take, which nothing compresses. Where terms meet, a term is a key of 128 bits made of its text on the way.
Documents of about the same length share a block of few documents, and the stored tables are
bucketed by block, so everything that goes by block or by document afterwards needs no exchange. Of the postings, only those of
rare terms are sent to their term, for the norms; the counts of the frequent ones are sent around. Terms are sent
a slice at a time, so that the disk never holds all that is sent; the slices of a row are columns, each read by itself.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from lodestone.functions.text import adjacent, compose, tokens
from lodestone.operators.ordering import with_sequence
from lodestone.operators.rows import fields_per_row, one_per_row
from lodestone.operators.sizing import broadcast_limit, lookup_join, measured_bytes, on_all_cores, small_enough
from lodestone.session import checkpoint_dir, co_partitioned, cut_lineage, remove, setting, tidied, written

SPAN = (1, 2)
KEY = ["a", "b"]
# Documents of one block, and tokens of a block of long ones.
BLOCK_DOCS = 32
BLOCK_TOKENS = 1 << 15
# Lengths in one block differ by a factor of 2 ** (1 / LENGTH_STEPS) at most.
LENGTH_STEPS = 4
_CLASS_BITS = 24
# Stored bytes of one bucket, about, and of one posting.
BUCKET_BYTES = 64 * 1024 * 1024
_POSTING_BYTES = 4
# Parts of all terms that are sent one after another.
SLICES = 4
# Rows that come to Python at once, and bytes of their tokens that are counted at once.
_ROWS_AT_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}
_BYTES_AT_ONCE = 1 << 21
# How stored tables are written: runs of sorted terms take little room as differences.
_COMPACT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
# Measured size of a term's key and count.
_COUNT_BYTES = 48
# Bins of one step in the search for a count.
_BINS = 4096

_TABLES = ("bags", "heads", "blocks")
_SCHEMAS = {
    "bags": "block INT, doc_id {id}, norm DOUBLE, bag ARRAY<STRUCT<term: STRING, tf: BIGINT>>",
    "heads": "block INT, doc_id {id}, dedup_key {key}, norm DOUBLE, n_terms INT",
    "blocks": "block INT, n_docs BIGINT, n_terms BIGINT",
}


def term_key(term: Column) -> list[Column]:
    """128 bits that stand for a term, as ``a`` and ``b``."""
    return [F.xxhash64(term).alias("a"), F.xxhash64(F.lit(7), term).alias("b")]


def _same(names: Sequence[str]) -> Column:
    """Whether longs on both sides (``_``: the other one) are equal, said so that the join does not hash them all."""
    differ = F.lit(0).cast("long")
    for n in names:
        differ = differ.bitwiseOR(F.col(n).bitwiseXOR(F.col(f"_{n}")))
    return differ == 0


def with_terms(table: DataFrame, asked: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Rows of a table with what is asked of their term. A small table of what is asked is broadcast, keyed by one long."""
    if not small:
        return table.join(asked, KEY, how)
    other = asked.withColumnsRenamed({c: f"_{c}" for c in KEY})
    met = table.join(F.broadcast(other), (F.col("a") == F.col("_a")) & _same(["b"]), how)
    return met if how == "left_semi" else met.drop("_a", "_b")


def within_blocks(posts: DataFrame, sought: DataFrame, on: Sequence[str]) -> DataFrame:
    """Postings with the rows of ``sought`` of the same block and ``on``, block by block, without an exchange of postings.

    The key of the hash table is one long made of the block and half of a hash; the rest is compared.
    """
    left = posts.withColumn("_h", F.hash(*on))
    right = sought.withColumn("_g", F.hash(*on)).withColumnsRenamed({c: f"_{c}" for c in ("block", *on)}).hint("shuffle_hash")
    same = _same([c for c in on if c in KEY])
    for c in on:
        if c not in KEY:  # of any type; two bounds, as an equation would become a key
            same = same & (F.col(c) >= F.col(f"_{c}")) & (F.col(c) <= F.col(f"_{c}"))
    met = left.join(right, (F.col("block") == F.col("_block")) & (F.col("_h") == F.col("_g")) & same)
    return met.drop("_h", "_g", *[f"_{c}" for c in ("block", *on)])


@dataclass(frozen=True)
class TextIndex:
    """``bags``: block, doc_id, norm and a row's terms with their counts; ``heads``: block, doc_id, dedup_key, norm, n_terms; ``blocks``:
    block, n_docs, n_terms; ``words``: term, tf, df.

    ``bags``, ``heads`` and ``blocks`` are bucketed by block. ``capped``: the vocabulary does not hold all terms of the bags.
    """

    bags: DataFrame
    heads: DataFrame
    blocks: DataFrame
    words: DataFrame
    n_docs: int
    n_postings: int
    n_buckets: int
    span: tuple[int, int]
    capped: bool
    path: str

    @property
    def vocab(self) -> DataFrame:
        """``term, a, b, tf, df, idf``."""
        return self.words.select("term", *term_key(F.col("term")), "tf", "df", idf(F.lit(self.n_docs), F.col("df")).alias("idf"))

    def _terms(self) -> DataFrame:
        """``block, doc_id, norm, term, a, b, tf`` of every term of the vocabulary that a document holds."""
        rows = fields_per_row(self.bags, ["block", "doc_id", "norm"], F.col("bag"), "term")
        rows = rows.select("block", "doc_id", "norm", "term", *term_key(F.col("term")), "tf")
        if not self.capped:
            return rows
        held = self.words.select(*term_key(F.col("term")))
        return with_terms(rows, held, small_enough(held), "left_semi")

    @property
    def posts(self) -> DataFrame:
        """``block, doc_id, norm, a, b, tf``, laid out by block."""
        return self._terms().drop("term")

    @property
    def tops(self) -> DataFrame:
        """For each block and term the largest tf / norm and the number of its documents, laid out by block."""
        return tops_of(self.posts)

    def postings(self, weights: bool = True) -> DataFrame:
        """One row per (document, term) with the term and its scaled weight; without ``weights`` the counts alone, for which nothing is looked up."""
        keys = self.heads.select(F.col("block").alias("_block"), F.col("doc_id").alias("_doc"), "dedup_key").hint("shuffle_hash")
        # by block alone, as the tables lie; the document is told by two bounds, as an equation would become a key
        own = (F.col("block") == F.col("_block")) & (F.col("doc_id") >= F.col("_doc")) & (F.col("doc_id") <= F.col("_doc"))
        named = self.bags.join(keys, own).select("doc_id", "dedup_key", "norm", "bag")
        rows = fields_per_row(named, ["doc_id", "dedup_key", "norm"], F.col("bag"), "term")
        if not weights and not self.capped:
            return rows.select("doc_id", "dedup_key", "term", "tf")
        rows = rows.select("*", *term_key(F.col("term")))
        # the same copies of a row are met again here, so the count is taken from the vocabulary
        known = rows.join(self.vocab.select(*KEY, "idf"), KEY) if self.capped else _with_counts(rows, self.words)
        weight = F.col("tf") * (F.col("idf") if self.capped else idf(F.lit(self.n_docs), F.col("df"))) / F.col("norm")
        return known.select("doc_id", "dedup_key", "term", "tf", weight.alias("weight"))

    def save(self, path: str) -> None:
        """Write the tables to a folder, bucketed as they are."""
        spark = self.heads.sparkSession
        for name in _TABLES:
            bucketed(getattr(self, name), self.n_buckets, f"{path}/{name}")
        self.words.write.options(**_COMPACT).mode("overwrite").parquet(f"{path}/words")
        kinds = {f.name: f.dataType.simpleString() for f in self.heads.schema}
        facts = spark.createDataFrame(
            [(self.n_docs, self.n_postings, self.n_buckets, *self.span, self.capped, kinds["doc_id"], kinds["dedup_key"])],
            "n_docs long, n_postings long, n_buckets int, low int, high int, capped boolean, id string, key string",
        )
        facts.write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        """The index in a folder; the tables are read in the layout they were written in."""
        facts = spark.read.parquet(f"{path}/facts").first()
        columns = {n: _SCHEMAS[n].format(id=facts["id"], key=facts["key"]) for n in _TABLES}
        tables = [bucketed_table(spark, f"{path}/{n}", columns[n], facts["n_buckets"]) for n in _TABLES]
        return TextIndex(
            *tables,
            spark.read.parquet(f"{path}/words"),
            facts["n_docs"],
            facts["n_postings"],
            facts["n_buckets"],
            (facts["low"], facts["high"]),
            facts["capped"],
            path,
        )

    def drop(self) -> None:
        """Delete the stored tables, once no search reads them any more."""
        remove(self.heads.sparkSession, self.path)


def tops_of(posts: DataFrame) -> DataFrame:
    """For each block and term of some postings the largest tf / norm and the number of documents."""
    return posts.groupBy("block", *KEY).agg(F.max(F.col("tf") / F.col("norm")).alias("top"), F.count("*").alias("n"))


def _frequent(words: DataFrame) -> DataFrame | None:
    """Keys and counts of the terms of the most documents, as many as a broadcast holds."""
    most = broadcast_limit(words) // _COUNT_BYTES
    if most < 1:
        return None
    cut, _ = count_cut(words, most, "df")
    return words.filter(F.col("df") > cut).select(*[c.alias(f"_{n}") for c, n in zip(term_key(F.col("term")), KEY)], F.col("df").alias("_df"))


def _split_by_count(rows: DataFrame, frequent: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Rows ``a, b, ...`` of frequent terms with ``df``, and all others; no row of a frequent term is moved."""
    if frequent is None:
        return None, rows
    same = (F.col("a") == F.col("_a")) & _same(["b"])
    return (
        rows.join(F.broadcast(frequent), same).withColumnRenamed("_df", "df").drop("_a", "_b"),
        rows.join(F.broadcast(frequent.select("_a", "_b")), same, "left_anti"),
    )


def _with_counts(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows ``term, a, b, ...`` with the ``df`` of their term, which ``words`` has for every one of them.

    What is sent goes by its text: a row's rare terms are sorted, so neighbours share letters, which keys of hashes do not.
    """
    here, others = _split_by_count(rows, _frequent(words))
    # a term that is not listed occurs in one document
    listed = words.filter(F.col("df") > 1).select("term", "df")
    sent = others.drop(*KEY).join(listed, "term", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    return sent if here is None else here.drop(*KEY).unionByName(sent)


def new_table() -> str:
    return f"default.lodestone_{uuid.uuid4().hex}"


def bucketed(df: DataFrame, buckets: int, path: str, by: Sequence[str] = ("block",), sort: Sequence[str] = (), more: str | None = None) -> str:
    """Write a table that is laid out by some columns as a bucketed one; reads of the name returned know the layout.

    Rows of a file are sorted by ``sort``, which takes less room. ``more``: the table of an earlier call, to which the rows are added.
    """
    table = more or new_table()
    laid = df.write.format("parquet").options(**_COMPACT).mode("append" if more else "overwrite").bucketBy(buckets, *by)
    with tidied(df):
        (laid.sortBy(*sort) if sort else laid).option("path", path).saveAsTable(table)
    return table


def bucketed_table(spark: SparkSession, path: str, columns: str, buckets: int, by: Sequence[str] = ("block",)) -> DataFrame:
    """A table that :func:`bucketed` wrote to a folder."""
    table = new_table()
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({', '.join(by)}) INTO {buckets} BUCKETS")
    return spark.table(table)


def _token_rows(texts: DataFrame, *keep: str) -> DataFrame:
    return texts.select(*keep, tokens(F.col("text")).alias("toks"))


def in_slice(key: Column, i: int) -> Column:
    """Whether a key, of any type, is of the ``i``-th of ``SLICES`` parts."""
    return F.pmod(F.xxhash64(key), F.lit(SLICES)) == i


def count_cut(counts: DataFrame, n: int, count: str = "tf") -> tuple[int, int]:
    """The count of the ``n``-th largest row, and how many rows have a larger one; (0, rows) if there are fewer.

    The counts are narrowed down by histograms of a bounded number of bins, so no task sorts rows.
    """
    top = counts.agg(F.max(count).alias("m"), F.count("*").alias("n")).first()
    if top["n"] <= n:
        return 0, top["n"]
    low, high, above = 0, top["m"], 0
    while low < high:
        width = -(-(high - low + 1) // _BINS)
        inside = counts.filter(F.col(count).between(low, high))
        bins = inside.groupBy(F.floor((F.col(count) - low) / width).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
        for row in bins:
            if above + row["n"] >= n:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            above += row["n"]
    return low, above


def largest_terms(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``term, tf, …`` with the largest ``tf``, ties by term; none of it in a single task."""
    if n <= 0:
        return counts.filter("false")
    cut, above = count_cut(counts, n)
    if not cut:
        return counts
    ties = with_sequence(counts.filter(F.col("tf") == cut), ["term"], "_seq").filter(F.col("_seq") <= n - above).drop("_seq")
    return counts.filter(F.col("tf") > cut).unionByName(ties)


def corpus_terms(texts: DataFrame, span: Sequence[int] = SPAN, max_features: int | None = None) -> DataFrame:
    """``term, tf`` over the whole corpus: all, or the ``max_features`` largest, ties by term.

    An n-gram is never more frequent than its words. So once single words alone fill the
    vocabulary, only n-grams whose words all reach the count of the last of them can
    enter it; the others are left out before they are counted and shuffled.
    """
    low, high = span
    toks = _token_rows(texts)
    parts: list[DataFrame] = []
    frequent = None
    if low == 1:
        single = one_per_row(toks, [], F.col("toks"), "term").groupBy("term").agg(F.count("*").alias("tf"))
        if max_features is not None:
            single = cut_lineage(single)
            least, _ = count_cut(single, max_features)
            if least:
                single = single.filter(F.col("tf") >= least)
                frequent = single.select("term") if small_enough(single) else None
        parts.append(single)
    for n in range(max(low, 2), high + 1):
        runs = fields_per_row(toks, [], adjacent(F.col("toks"), n), "w0")
        if frequent is not None:
            for word in runs.columns:
                runs = runs.join(F.broadcast(frequent.withColumnRenamed("term", word)), word, "left_semi")
        words = [f"w{i}" for i in range(n)]
        counted = runs.groupBy(*words).agg(F.count("*").alias("tf"))
        parts.append(counted.select(F.concat_ws(" ", *words).alias("term"), "tf"))
    terms = parts[0]
    for part in parts[1:]:
        terms = terms.unionByName(part)
    return terms if max_features is None else largest_terms(cut_lineage(terms), max_features)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def term_counts(texts: DataFrame, keep: Sequence[str], span: Sequence[int], slices: int = 1) -> DataFrame:
    """Each row of ``texts`` with ``n_tokens`` and ``bag``, its terms and how often each occurs, counted within the row; with ``slices``
    ``bag0``, ``bag1``, ..., each with the terms of one slice."""
    rows = _token_rows(texts, *keep).select(*keep, F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("line"))
    return _counted(rows, span, slices)


def _counted(rows: DataFrame, span: Sequence[int], slices: int = 1) -> DataFrame:
    """Rows with their tokens as ``line``, joined by spaces, with ``bag`` instead, or with the terms of each of several slices."""
    bag = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
    names = ["bag"] if slices == 1 else [f"bag{i}" for i in range(slices)]
    kept = [f for f in rows.schema if f.name != "line"]
    out = T.StructType([*kept, *(T.StructField(n, bag) for n in names)])
    return rows.select(*[f.name for f in kept], "line").mapInArrow(_counts(tuple(span), names), out)


def _counts(span: tuple[int, int], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            parts = np.cumsum(pc.binary_length(frame["line"]).to_numpy(zero_copy_only=False)) // _BYTES_AT_ONCE
            cuts = np.r_[np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])[: len(parts)], len(parts)]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                some = frame.slice(low, high - low)
                columns = [c for c, n in zip(some.columns, some.schema.names) if n != "line"]
                kept = [n for n in some.schema.names if n != "line"]
                yield pa.RecordBatch.from_arrays([*columns, *_bags(some["line"], span, len(names))], [*kept, *names])

    return batches


def _bags(lines: pa.Array, span: tuple[int, int], slices: int) -> list[pa.Array]:
    """The distinct terms of each line in order, with their counts, by slice.

    A space sorts before all that a token is made of, so terms are in the order of their words, one that ends first coming first.
    """
    split = pc.split_pattern(lines, " ")
    flat = split.flatten()
    row = np.repeat(np.arange(len(lines)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # a line without tokens is ''
    coded, row = flat.filter(pa.array(there)).dictionary_encode(), row[there]
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    place = np.empty(len(words) + 1, np.int64)
    place[order.to_numpy()] = np.arange(1, len(words) + 1)  # 0: no word
    word = place[coded.indices.to_numpy()]
    grams = [np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :]) for n in range(span[0], span[1] + 1)]
    at, n_words = np.concatenate(grams), np.repeat(np.arange(span[0], span[1] + 1), [len(g) for g in grams])
    of = [np.where(n_words > i, word[np.minimum(at + i, len(word) - 1)], 0) for i in range(span[1])]
    key, size = row[at], len(lines)
    for w in of:
        if size * (len(words) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = len(key)
        key, size = key * (len(words) + 1) + w, size * (len(words) + 1)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]][: len(order)])
    tf = np.diff(np.r_[first, len(order)])
    own, at, n_words, of = row[at[order[first]]], order[first], n_words[order[first]], [w[order[first]] for w in of]
    part = _slice_of(words, of, slices)
    bags = []
    for i in range(slices):
        inside = np.flatnonzero(part == i)
        texts, rows = [], []
        for n in range(span[0], span[1] + 1):
            some = inside[n_words[inside] == n]
            each = [words.take(pa.array(w[some] - 1)) for w in of[:n]]
            texts.append(each[0] if n == 1 else pc.binary_join_element_wise(*each, " "))
            rows.append(some)
        back = np.empty(len(order) + 1, np.int64)
        back[np.concatenate(rows)] = np.arange(len(inside))
        held = pa.StructArray.from_arrays([pa.concat_arrays(texts).take(pa.array(back[inside])), pa.array(tf[inside], pa.int64())], ["term", "tf"])
        bags.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(own[inside], minlength=len(lines)))], pa.int32()), held))
    return bags


def _slice_of(words: pa.Array, of: list[np.ndarray], slices: int) -> np.ndarray:
    """The slice of each term, a hash of its words' bytes; ``of``: the first, second, ... word of each, counted from 1, or 0 for none."""
    if slices == 1 or not len(words):
        return np.zeros(len(of[0]), np.int64)
    n = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    letters = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer(), np.uint8)
    powers = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
    mixed = np.add.reduceat((letters + np.uint64(1)) * powers[np.arange(len(letters)) - np.repeat(ends - n, n)], ends - n)
    hashed = np.r_[np.zeros(1, np.uint64), mixed]
    whole = np.zeros(len(of[0]), np.uint64)
    for w in of:
        whole = (whole ^ hashed[w]) * np.uint64(0xBF58476D1CE4E5B9)
        whole ^= whole >> np.uint64(31)
    return ((whole >> np.uint64(20)) % np.uint64(slices)).astype(np.int64)


def _block(lengths: dict[int, tuple[int, int]]) -> Column:
    """A document's block: its class of lengths, and one of so many parts of the class."""
    parts = []
    for own, (docs, toks) in sorted(lengths.items()):
        per_block = max(1, min(BLOCK_DOCS, BLOCK_TOKENS * docs // max(1, toks)))
        parts += [F.lit(own), F.lit(min(1 << _CLASS_BITS, max(1, -(-docs // per_block))))]
    many = F.element_at(F.create_map(*parts), _length_class()) if parts else F.lit(1)
    return F.shiftleft(_length_class(), _CLASS_BITS) + F.pmod(F.xxhash64("doc_id"), many).cast("int")


def _length_class() -> Column:
    return F.floor(LENGTH_STEPS * F.log2(F.col("n_tokens") + 1)).cast("int")


def build_index(
    kb: DataFrame,
    text_cols: Sequence[str],
    dedup_col: str | Column,
    id_col: str = "doc_id",
    span: Sequence[int] = SPAN,
    max_features: int | None = None,
    buckets: int | None = None,
) -> TextIndex:
    """Index every row of ``kb`` over the text composed of ``text_cols``.

    ``dedup_col`` marks rows that count as the same answer. Unless given, there is a bucket for every ``BUCKET_BYTES`` of
    bags, and at least one for each shuffle partition and three for each core. The counts of each row are stored for the vocabulary and the
    norms, a column for each slice of the terms; the rows' tokens are exchanged once, to the layout by block, and what comes back to a block is the norm of each row.
    """
    spark = kb.sparkSession
    dedup = F.col(dedup_col) if isinstance(dedup_col, str) else dedup_col
    texts = kb.select(F.col(id_col).alias("doc_id"), dedup.alias("dedup_key"), compose(*[F.col(c) for c in text_cols]).alias("text"))
    with setting(spark, _ROWS_AT_ONCE):
        counted, folder = written(term_counts(on_all_cores(texts.drop("dedup_key"), "doc_id"), ["doc_id"], span, SLICES), _COMPACT)
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"

    own = co_partitioned(spark)  # a session of its own, so that the caller's settings stay as they are
    bags = own.read.schema(counted.schema).parquet(folder)
    slices = [f"bag{i}" for i in range(SLICES)]
    n_terms = reduce(Column.__add__, [F.size(f"{c}.tf") for c in slices])
    shape = bags.groupBy(_length_class().alias("c")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.sum(n_terms).alias("m")).collect()
    n_docs = sum(r["n"] for r in shape)
    if buckets is None:
        least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        buckets = max(least, -(-sum(r["m"] for r in shape) * _POSTING_BYTES // BUCKET_BYTES))

    capped = max_features is not None
    held_at = f"{path}/{'terms' if capped else 'words'}"
    for c in slices:
        vocab = fields_per_row(bags, [], F.col(c), "term").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
        with tidied(vocab):  # sorted terms take less room
            vocab.sortWithinPartitions("term").write.options(**_COMPACT).mode("append").parquet(held_at)
    if capped:
        largest_terms(own.read.parquet(held_at), max_features).write.options(**_COMPACT).parquet(f"{path}/words")
        remove(spark, held_at)
    words = own.read.parquet(f"{path}/words")

    block = _block({r["c"]: (r["n"], r["t"]) for r in shape}).alias("block")
    rows = [fields_per_row(bags.select(block, "doc_id", c), ["block", "doc_id"], F.col(c), "term") for c in slices]
    norms, norms_at = _norms([r.select("block", "doc_id", *term_key(F.col("term")), "tf") for r in rows], words, n_docs, capped)
    remove(spark, folder)

    sent = _token_rows(texts, "doc_id", "dedup_key")  # tokens hold no space, so their text says the same in less room
    sent = sent.select("doc_id", "dedup_key", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("line"))
    laid = sent.select(block, "doc_id", "dedup_key", "line").repartition(buckets, "block")
    back = norms.repartition(buckets, "block").select(F.col("block").alias("_block"), F.col("doc_id").alias("_doc"), "norm", "n_terms")
    # from the side that belongs to the session of its own, whose settings then hold
    known = back.hint("shuffle_hash").join(laid, (F.col("block") == F.col("_block")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "right")
    for name, value in _ROWS_AT_ONCE.items():
        own.conf.set(name, value)
    bags_at = bucketed(_counted(known.select("block", "doc_id", "dedup_key", "norm", "n_terms", "line"), span), buckets, f"{path}/bags")

    held = own.table(bags_at)
    # a row without an id has no terms of its own in the list of documents
    of = lambda c, none: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, none)).otherwise(none).alias(c)
    heads = held.select("block", "doc_id", "dedup_key", of("norm", F.lit(0.0)), of("n_terms", F.lit(0)))
    heads = bucketed(heads, buckets, f"{path}/heads")
    blocks = own.table(heads).groupBy("block").agg(F.count("*").alias("n_docs"), F.sum("n_terms").alias("n_terms"))
    blocks = bucketed(blocks, buckets, f"{path}/blocks")
    n_postings = own.table(blocks).agg(F.coalesce(F.sum("n_terms"), F.lit(0)).alias("m")).first()["m"]
    remove(spark, norms_at)
    bags = spark.table(bags_at).select("block", "doc_id", "norm", "bag")
    return TextIndex(bags, spark.table(heads), spark.table(blocks), spark.read.parquet(f"{path}/words"), n_docs, n_postings, buckets, (span[0], span[1]), capped, path)


def _norms(slices: list[DataFrame], words: DataFrame, n_docs: int, capped: bool) -> tuple[DataFrame, str]:
    """``block, doc_id, norm, n_terms`` from the slices of rows ``block, doc_id, a, b, tf``, and the folder where they are.

    Frequent terms are weighed where they are. The others meet at their term, with 96 bits of the key, and are counted there,
    a slice of the terms at a time.
    """
    own = ["block", "doc_id"]
    w = F.col("tf") * idf(F.lit(n_docs), F.col("df"))
    squares = [F.sum(w * w).alias("s"), F.count("*").alias("n")]
    frequent_at = None
    if capped:
        held = words.select(*term_key(F.col("term")), "df")
        steps = [with_terms(reduce(DataFrame.unionByName, slices), held, small_enough(held))]
    else:
        frequent = _frequent(words)
        if frequent is not None:
            frequent, frequent_at = written(frequent)
        split = [_split_by_count(rows, frequent) for rows in slices]
        short = [rare.select(*own, "a", F.shiftright("b", 32).cast("int").alias("c"), F.col("tf").cast("int").alias("tf")).repartition("a") for _, rare in split]
        steps = [s.withColumn("df", F.count("*").over(W.partitionBy("a", "c"))) for s in short]
        if frequent_at:
            steps.append(reduce(DataFrame.unionByName, [here for here, _ in split]))
    parts = [written(step.groupBy(*own).agg(*squares), _COMPACT) for step in steps]
    whole = reduce(DataFrame.unionByName, [part for part, _ in parts])
    norms = written(whole.groupBy(*own).agg(F.sqrt(F.sum("s")).alias("norm"), F.sum("n").cast("int").alias("n_terms")), _COMPACT)
    for at in [at for _, at in parts] + ([frequent_at] if frequent_at else []):
        remove(words.sparkSession, at)
    return norms


def query_vectors(index: TextIndex, queries: DataFrame) -> tuple[DataFrame, int]:
    """``query_id, a, b, tf, df, idf, weight`` for the vocabulary terms of each query text.

    Also the bytes of such a table, measured on all terms of the queries, or on those of the vocabulary where that is sent to them.
    """
    with setting(queries.sparkSession, _ROWS_AT_ONCE):
        return _vectors(index, queries)


def _vectors(index: TextIndex, queries: DataFrame) -> tuple[DataFrame, int]:
    bags = term_counts(on_all_cores(queries, "query_id"), ["query_id"], index.span)
    rows = fields_per_row(bags, ["query_id"], F.col("bag"), "term").select("query_id", *term_key(F.col("term")), "tf")
    vocab = index.vocab.select(*KEY, "df", "idf")
    if small_enough(vocab):  # other terms are left out where they are found
        known = cut_lineage(with_terms(rows, vocab, True).select("query_id", *KEY, "tf", "df", "idf"))
        size = measured_bytes(known)
    else:
        rows = cut_lineage(rows)
        size = 2 * measured_bytes(rows)  # the table has not twice as many columns
        small = size <= broadcast_limit(rows)
        asked = rows.select(*KEY).distinct()
        held = with_terms(vocab, asked, small, "left_semi")
        known = rows.join(F.broadcast(held), KEY) if small else lookup_join(rows, cut_lineage(held), KEY, "inner", ["query_id"])
    w = F.col("tf") * F.col("idf")
    scaled = w / F.sqrt(F.sum(w * w).over(W.partitionBy("query_id")))
    return cut_lineage(known.select("query_id", *KEY, "tf", "df", "idf", scaled.alias("weight"))), size


def index_shape(index: TextIndex) -> DataFrame:
    """Documents, vocabulary size and stored weights of an index, as one row."""
    docs = index.blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_weights"))
    terms = index.words.agg(F.count("*").alias("n_terms"))
    return docs.select("n_docs", terms.scalar().alias("n_terms"), "n_weights")
