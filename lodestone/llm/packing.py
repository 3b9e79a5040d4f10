"""Packing tokenized documents into sequences of bounded length.

How many pieces there are of each length is all that matters for which lengths share a
sequence, so the packing is planned on that table, of one number for each possible length:
pieces above a third of the capacity are matched in pairs, largest with the largest that fits
(no sequence holds three of them), and smaller ones go, largest first, to the tightest gap.
The plan says which ranks of a length go to which run of sequences; every piece finds its place
by its rank, so nothing but the lengths' counts passes through the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.bpe import pieces, vocabulary, word_ids
from lodestone.llm.common import numbered, stored, with_text_columns

CAPACITY = 2048
# The id after each document.
SEPARATOR = 0

_TOKENS = [pa.field("lengths", pa.list_(pa.int64())), pa.field("crcs", pa.list_(pa.int64()))]
_RANK_BITS = 44


def text_ids(texts: list[str], tokenizer: str):
    """Token numbers of each text, in order."""
    vocab = vocabulary(tokenizer)
    for _, some in pieces(texts, vocab):
        flat, counts = word_ids(vocab, some)
        firsts = np.cumsum(counts) - counts
        many = counts[some.word]
        ends = np.cumsum(many)
        ids = flat[np.repeat(firsts[some.word] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        sizes = np.bincount(some.text, weights=many, minlength=some.n_texts).astype(np.int64)
        yield from np.split(ids, np.cumsum(sizes)[:-1])


def _tokens(texts: pa.Array, tokenizer: str, capacity: int) -> dict[str, pa.Array]:
    lengths, crcs = [], []
    for ids in text_ids(texts.fill_null("").to_pylist(), tokenizer):
        data = np.append(ids, SEPARATOR).astype("<u4").tobytes()
        cuts = range(0, len(data), 4 * capacity)
        lengths.append([min(4 * capacity, len(data) - i) // 4 for i in cuts])
        crcs.append([zlib.crc32(data[i : i + 4 * capacity]) for i in cuts])
    return {"lengths": pa.array(lengths, _TOKENS[0].type), "crcs": pa.array(crcs, _TOKENS[1].type)}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go, from how many there are.

    Rows are (length, first rank, pieces per sequence, first sequence, offset), in order of
    length and rank; each holds for the ranks up to the next.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is longer than a sequence")
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # in order; the runs of sequences with each gap are in open_
    open_: dict[int, list[tuple[int, int]]] = {}
    n_sequences = 0

    def place(length: int, n: int, each: int, first: int, gap: int) -> None:
        rows.append((length, used[length], each, first, capacity - gap))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        i = bisect_left(large, min(length, capacity - length) + 1) - 1
        if i >= 0 and large[i] == length and left[length] == 1:
            i -= 1
        if i < 0:
            n = left[length]
            place(length, n, 1, n_sequences, capacity)
            leave(capacity - length, n_sequences, n)
        else:
            other = large[i]
            n = left[length] // 2 if other == length else min(left[length], left[other])
            place(length, n, 1, n_sequences, capacity)
            place(other, n, 1, n_sequences, capacity - length)
            leave(capacity - length - other, n_sequences, n)
        n_sequences += n
        large = [x for x in large if x in left] if length not in left or i >= 0 else large

    for length in sorted(left, reverse=True):
        while length in left:
            i = bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(i)
            else:
                gap, first = capacity, n_sequences
                n = -(-left[length] // (capacity // length))
                n_sequences += n
            each = gap // length
            full, rest = divmod(min(left[length], n * each), each)
            if full:
                place(length, full * each, each, first, gap)
                leave(gap - each * length, first, full)
            if rest:
                place(length, rest, rest, first + full, gap)
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + (rest > 0), n - full - (rest > 0))
    return sorted(rows)


def _places(batches, shared: Broadcast):
    table = shared.value
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
        row = np.searchsorted(table["key"], (length << _RANK_BITS) + rank, "right") - 1
        within = rank - table["rank"][row]
        sequence = table["sequence"][row] + within // table["each"][row]
        offset = table["offset"][row] + within % table["each"][row] * length
        names = [n for n in batch.schema.names if n != "_rank"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its token ids and then the separator's; only longer ones are cut, at
    multiples of ``capacity``. Null and empty texts are the separator alone. Repeated rows, and
    rows that share an id or have none, are packed one by one. Other columns are not read.
    An empty table gives no rows.
    """
    tokens = with_text_columns(docs.select(F.col(id).alias("_id"), text), partial(_tokens, tokenizer=tokenizer, capacity=capacity), _TOKENS, text)
    found = stored(
        tokens.select("_id", F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "p")).select(
            "_id",
            "piece",
            (F.col("piece") * F.lit(capacity).cast("long")).alias("start"),
            F.col("p.lengths").alias("length"),
            F.col("p.crcs").alias("ids_crc32"),
        )
    )
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    table = {"key": (rows[:, 0] << _RANK_BITS) + rows[:, 1], "rank": rows[:, 1], "each": rows[:, 2], "sequence": rows[:, 3], "offset": rows[:, 4]}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ranked = numbered(found, ["length"], ["_id", "piece", "ids_crc32"], "_rank", sum(counts.values()))
    kind = found.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    placed = ranked.select("_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(partial(_places, shared=shared), schema)
    return placed.withColumnRenamed("_id", id)
