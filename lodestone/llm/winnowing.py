"""Benchmark passages inside documents, found by winnowed fingerprints.

Of every ``WINDOW`` consecutive words, the rightmost smallest of their ``GRAM``-word hashes is
a fingerprint. Two texts that share so many words share that fingerprint, so documents are
looked up by their fingerprints alone, and each hit is extended to the whole windows around
it, which are compared by 128 bits.

The fingerprints of the benchmark are broadcast in blocks of bounded text; documents are read
once, not shuffled, whatever the benchmark holds. More than one block means one more pass for
each, and their hits are merged by document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import aside, stored, text_key, with_text_columns, without
from lodestone.llm.wordhash import ALNUM, Words, lists, slices, words_of

WINDOW = 10
GRAM = 5
# Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20

FIELDS = [
    pa.field("n_words", pa.int64()),
    pa.field("n_hit", pa.int64()),
    pa.field("item_ids", pa.list_(pa.string())),
    pa.field("span_starts", pa.list_(pa.int32())),
    pa.field("span_ends", pa.list_(pa.int32())),
]
_SPANS = "arrays_zip(span_starts, span_ends)"


def fingerprints(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps of each text with at least ``window`` words."""
    hashes = words.runs(gram)
    starts = np.flatnonzero(words.left() >= window)
    best, at = hashes[starts], starts.copy()
    for j in range(1, window - gram + 1):
        other = hashes[starts + j]
        lower = other <= best  # the rightmost of equals
        best[lower] = other[lower]
        at[lower] = starts[lower] + j
    kept = np.unique(at)
    return kept, hashes[kept]


@dataclass
class Index:
    """Windows of one block of benchmark texts.

    ``keys`` are sorted first hashes of windows, ``checks`` their second; the items with
    window ``i`` are ``names`` at ``items[starts[i]:starts[i + 1]]`` (-1: no id). ``prints``
    are the sorted fingerprints, ``table`` marks their low bits, and ``lengths`` are the
    lengths of windows that occur.
    """

    prints: np.ndarray
    table: np.ndarray
    lengths: list[int]
    keys: np.ndarray
    checks: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    names: pa.Array


_TABLE_BITS = 20


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)


def build_index(ids: list[str | None], texts: list[str], window: int = WINDOW, gram: int = GRAM) -> Index:
    """The index over the items of one block; those that share an id are one item."""
    names = sorted({i for i in ids if i is not None})
    places = {name: i for i, name in enumerate(names)}
    of_text = np.array([places.get(i, -1) for i in ids], dtype=np.int64)
    prints, keys, checks, items, lengths, before = [], [], [], [], set(), 0
    for raw, offsets in slices(pa.array(texts, pa.string())):
        words = words_of(raw, offsets, ALNUM)
        _, found = fingerprints(words, window, gram)
        prints.append(found)
        counts = words.counts
        for k in sorted({min(int(n), window) for n in np.unique(counts) if n}):
            own = counts[words.text] >= window if k == window else counts[words.text] == k
            at = np.flatnonzero(own & (words.left() >= k))
            lengths.add(k)
            keys.append(words.runs(k, at))
            checks.append(words.runs(k, at, salt=1))
            items.append(of_text[words.text[at] + before])
        before += len(offsets) - 1
    none = np.zeros(0, np.uint64)
    prints = np.unique(np.concatenate([none, *prints]))
    columns = (keys, checks, [(i + 1).astype(np.uint64) for i in items])
    rows = np.unique(np.stack([np.concatenate([none, *x]) for x in columns], axis=1), axis=0)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    first = np.flatnonzero(new)
    starts = np.append(first, len(rows))
    items = rows[:, 2].astype(np.int64) - 1
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    table[_low(prints)] = True
    lengths = sorted(lengths)
    return Index(prints, table, lengths, rows[first, 0], rows[first, 1], starts, items, pa.array(names, pa.string()))


def _windows_at(index: Index, words: Words, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the positions, those whose ``k`` words are a window of the index, and its number."""
    keys, checks = words.runs(k, at), words.runs(k, at, salt=1)
    place = np.searchsorted(index.keys, keys)
    number = np.full(len(at), -1)
    # windows that agree in the first hash lie side by side, as a rule one
    while len(at):
        open_ = (place < len(index.keys)) & (number < 0)
        open_[open_] = index.keys[place[open_]] == keys[open_]
        if not open_.any():
            break
        same = open_.copy()
        same[open_] = index.checks[place[open_]] == checks[open_]
        number[same] = place[same]
        place[open_] += 1
    return at[number >= 0], number[number >= 0]


def hits_of(index: Index, words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and number of each window of the index that occurs in the texts."""
    left = words.left()
    found = []
    for k in index.lengths:
        if k < window:  # a short item is its own fingerprint
            at = np.flatnonzero(left >= k)
        else:
            at, prints = fingerprints(words, window, gram)
            near = index.table[_low(prints)]
            at, prints = at[near], prints[near]
            at = at[np.isin(prints, index.prints)]
            # extend each hit to the windows that hold it
            at = np.unique((at[:, None] - np.arange(window - gram + 1)).ravel())
            at = at[at >= 0]
            at = at[left[at] >= window]
        at, number = _windows_at(index, words, k, at)
        found.append((at, np.full(len(at), k), number))
    if not found:
        return tuple(np.zeros((3, 0), dtype=np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _per_text(raw: np.ndarray, offsets: np.ndarray, index: Index, window: int, gram: int) -> list[pa.Array]:
    words = words_of(raw, offsets, ALNUM)
    n = len(offsets) - 1
    start, length, number = hits_of(index, words, window, gram)
    edge = np.zeros(len(words.text) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    hit = np.cumsum(edge[:-1]) > 0
    counts = np.bincount(words.text[hit], minlength=n)
    # spans of hit words, cut at the texts
    opens = hit.copy()
    opens[1:] &= ~hit[:-1] | (words.text[1:] != words.text[:-1])
    closes = hit.copy()
    closes[:-1] &= ~hit[1:] | (words.text[1:] != words.text[:-1])
    at = np.flatnonzero(opens)
    of = words.text[at]
    spans = np.bincount(of, minlength=n)
    firsts = words.firsts[:-1][of]
    # items by text: windows of each text once, then their items once
    seen = np.unique(np.stack([words.text[start], number], axis=1), axis=0)
    sizes = index.starts[seen[:, 1] + 1] - index.starts[seen[:, 1]]
    places = np.repeat(index.starts[seen[:, 1]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    pairs = np.stack([np.repeat(seen[:, 0], sizes), index.items[places]], axis=1)
    pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
    return [
        pa.array(words.counts, pa.int64()),
        pa.array(counts, pa.int64()),
        lists(index.names.take(pa.array(pairs[:, 1])), np.bincount(pairs[:, 0], minlength=n), pa.string()),
        lists((at - firsts).astype(np.int32), spans, pa.int32()),
        lists((np.flatnonzero(closes) + 1 - firsts).astype(np.int32), spans, pa.int32()),
    ]


def _columns(texts: pa.Array, shared: Broadcast, window: int, gram: int) -> dict[str, pa.Array]:
    parts = [_per_text(raw, offsets, shared.value, window, gram) for raw, offsets in slices(texts)]
    if not parts:
        return {f.name: pa.array([], f.type) for f in FIELDS}
    return {f.name: pa.concat_arrays(list(x)) for f, x in zip(FIELDS, zip(*parts))}


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of bounded text, one at a time on the driver.

    Blocks are dealt by a hash and halved until none is too large; a block of one item may be.
    """
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    size = F.sum(F.octet_length("text").cast("long"))
    total = items.agg(size.alias("b")).first()["b"] or 0
    n = max(1, -(-total // block_bytes))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
        if n == 1:
            break
        worst = dealt.groupBy("block").agg(size.alias("b"), F.countDistinct("id", "text").alias("n")).filter("n > 1").agg(F.max("b").alias("b")).first()["b"]
        if (worst or 0) <= 2 * block_bytes:
            break
        n *= 2
    for block in range(n):
        yield n, dealt.filter(F.col("block") == block).select("id", "text").distinct().collect()


def flag_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep_text: bool = False,
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents with what they share with the benchmark items.

    Adds ``n_words``, ``n_hit`` (words inside a window of an item), ``item_ids`` (sorted, each
    once), ``spans`` (first hit word and the one after the last, counted from 0) and
    ``contaminated``; columns of these names are replaced.

    Null and empty texts have no words, are not hit, and as items hit nothing. An item
    of fewer than ``window`` words is a window by itself. Items that share an id are one item;
    one without an id marks words but is not listed. Every row of ``docs`` is returned, repeated
    rows with the same result; a very long text is handled whole, alone in its slice.
    """
    base, back = aside(without(docs, ["n_words", "n_hit", "item_ids", "spans", "contaminated"]), ["span_starts", "span_ends"], [text])
    parts = []
    for n, rows in _blocks(items, item_id, item_text, block_bytes):
        index = build_index([r["id"] for r in rows], [r["text"] for r in rows], window, gram)
        make = partial(_columns, shared=docs.sparkSession.sparkContext.broadcast(index), window=window, gram=gram)
        if n == 1:
            one = with_text_columns(base, make, FIELDS, text, keep_text)
            return back(one.withColumn("spans", F.expr(_SPANS)).drop("span_starts", "span_ends").withColumn("contaminated", F.col("n_hit") > 0))
        # equal texts have equal hits, so one row for each text is enough
        keyed = with_text_columns(base.select(text, text_key(text).alias("_key")), make, FIELDS, text)
        hit = keyed.filter("n_hit > 0").withColumn("spans", F.expr(_SPANS))
        parts.append(hit.groupBy("_key").agg(F.first("item_ids").alias("item_ids"), F.first("spans").alias("spans")))
        if len(parts) == 16:  # so that the plan does not grow with the benchmark
            parts = [stored(_merged(parts))]
    nothing = docs.sparkSession.sparkContext.broadcast(build_index([], [], window, gram))
    counted = with_text_columns(base.withColumn("_key", text_key(text)), partial(_columns, shared=nothing, window=window, gram=gram), FIELDS, text, keep_text)
    hit = _merged(parts).withColumn("n_hit", F.expr(f"size({_COVERED})").cast("long"))
    out = counted.drop("n_hit", "item_ids", "span_starts", "span_ends").join(hit, "_key", "left").drop("_key")
    none = {"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "spans": F.array().cast(hit.schema["spans"].dataType)}
    filled = out.select(*[c for c in out.columns if c not in none], *[F.coalesce(c, v).alias(c) for c, v in none.items()])
    return back(filled.withColumn("contaminated", F.col("n_hit") > 0))


_COVERED = "array_distinct(flatten(transform(spans, s -> sequence(s.span_starts, s.span_ends - 1))))"


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Hits of several blocks by document: ids once, overlapping spans as one."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    both = rows.groupBy("_key").agg(  # at most a row for each block
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    covered = both.withColumn("_at", F.expr(_COVERED)).withColumn("_after", F.expr("transform(_at, p -> p + 1)"))
    return covered.select(
        "_key",
        "item_ids",
        F.arrays_zip(
            F.array_sort(F.array_except("_at", "_after")).alias("span_starts"),
            F.array_sort(F.array_except("_after", "_at")).alias("span_ends"),
        ).alias("spans"),
    )
