"""Vectors as short codes: a codebook for each part, fitted by rounds of nearest entries, searched by a GNAT.

Components are integers, so all distances and sums are exact. The GNAT of a codebook has some
entries as split points; every other entry goes with its nearest split point, and each pair of a split point and
such a group holds the range of their distances. A group whose range lies beyond what the best entry so far
leaves open is passed over as a whole, by the triangle inequality. Distances there are floats, rounded outward, and only
a strict excess rules a group out, so an entry that ties is always met and compared by integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import stored, with_text_columns
from lodestone.operators.sizing import lookup_join

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Split points of one node, and the entries that are searched without a node of their own.
DEGREE = 4
LEAF = 4
# Scaled components stay below this, so that squared distances fit 64 bits.
LIMIT = 1 << 27
# Numbers worked on at a time.
SLICE = 1 << 20
# Outward rounding, well above the error of a float's square root.
_WIDEN = 1e-12


@dataclass(frozen=True)
class Gnat:
    """``splits``: entries at this node; ``groups``: nodes or leaves (arrays of entries); ``low``, ``high``: ranges by split and group."""

    splits: np.ndarray
    groups: tuple
    low: np.ndarray
    high: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of one array to all of the other."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def build(entries: np.ndarray, own: np.ndarray | None = None) -> Gnat | np.ndarray:
    """The tree over the rows of ``entries``, or a leaf. Split points are far from each other."""
    own = np.arange(len(entries)) if own is None else own
    if len(own) <= LEAF:
        return own
    chosen = [0]
    nearest = squared(entries[own], entries[own[:1]])[:, 0]
    while len(chosen) < DEGREE and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries[own], entries[own[chosen[-1:]]])[:, 0])
    if len(chosen) == 1:  # all are equal
        return own
    splits = own[chosen]
    rest = np.delete(own, chosen)
    apart = squared(entries[rest], entries[splits])
    of = apart.argmin(axis=1)
    kept = [g for g in range(len(splits)) if (of == g).any()]
    ranges = np.sqrt(apart.astype(np.float64))
    low = np.array([[ranges[of == g, s].min() for g in kept] for s in range(len(splits))]).reshape(len(splits), len(kept))
    high = np.array([[ranges[of == g, s].max() for g in kept] for s in range(len(splits))]).reshape(len(splits), len(kept))
    return Gnat(splits, tuple(build(entries, rest[of == g]) for g in kept), low * (1 - _WIDEN), high * (1 + _WIDEN))


def _offer(best: np.ndarray, error: np.ndarray, rows: np.ndarray, entries: np.ndarray, d: np.ndarray) -> None:
    """Take the nearest of some entries where it is nearer than the best so far, or as near and of a lower index."""
    order = np.argsort(entries)
    d = d[:, order]
    at = d.argmin(axis=1)  # the first of equal ones
    least, entry = d[np.arange(len(d)), at], entries[order][at]
    better = (least < error[rows]) | ((least == error[rows]) & (entry < best[rows]))
    best[rows[better]], error[rows[better]] = entry[better], least[better]


def _search(node: Gnat | np.ndarray, entries: np.ndarray, points: np.ndarray, rows: np.ndarray, best: np.ndarray, error: np.ndarray) -> None:
    if not len(rows):
        return
    if not isinstance(node, Gnat):
        _offer(best, error, rows, node, squared(points[rows], entries[node]))
        return
    d = squared(points[rows], entries[node.splits])
    _offer(best, error, rows, node.splits, d)
    root = np.sqrt(d.astype(np.float64))
    least, most = root * (1 - _WIDEN), root * (1 + _WIDEN)
    for g, group in enumerate(node.groups):
        reach = np.sqrt(error[rows].astype(np.float64))[:, None] * (1 + _WIDEN)
        out = (least - reach > node.high[:, g]) | (most + reach < node.low[:, g])
        _search(group, entries, points, rows[~out.any(axis=1)], best, error)


def nearest_entries(tree: Gnat | np.ndarray, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each point's nearest entry, the lowest of equal ones, and its squared distance."""
    best = np.full(len(points), len(entries), dtype=np.int64)
    error = np.full(len(points), np.iinfo(np.int64).max)
    _search(tree, entries, points, np.arange(len(points)), best, error)
    return best, error


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; the column holds no nulls."""
    values = np.asarray(column.flatten(), dtype=np.int64)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _slices(points: np.ndarray, per_row: int) -> Iterator[np.ndarray]:
    step = max(1, SLICE // max(1, per_row))
    for at in range(0, len(points), step):
        yield points[at : at + step]


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sum of the parts at each entry, one row for each part and entry of a task."""
    trees = [build(b) for b in books]
    entries, width = books[0].shape
    counts = np.zeros((len(books), entries), dtype=np.int64)
    totals = np.zeros((len(books), entries, width), dtype=np.int64)
    for batch in batches:
        for rows in _slices(_matrix(batch.column(0)), entries * width):
            for p, (tree, book) in enumerate(zip(trees, books)):
                part = rows[:, p * width : (p + 1) * width]
                best, _ = nearest_entries(tree, book, part)
                counts[p] += np.bincount(best, minlength=entries)
                np.add.at(totals[p], best, part)
    p, e = np.nonzero(counts)
    lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, pa.array(totals[p, e].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), lists.cast(schema.field("total").type)], schema=schema)


_SUMS = pa.schema([("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def _moved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round. What reaches the driver is one row for each part and entry."""
    found = vectors.select("ints").mapInArrow(partial(_sums, books=books, schema=_SUMS), "part long, entry long, n long, total array<long>")
    # one row per task, part and entry; added up component by component
    each = found.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
    added = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new = [b.copy() for b in books]
    for row in added.collect():
        if row["at"] is not None:
            new[row["part"]][row["entry"], row["at"]] = int(row["x"]) // row["n"]
    return new


def _codes(column: pa.Array, books: list[np.ndarray]) -> dict[str, pa.Array]:
    trees = [build(b) for b in books]
    entries, width = books[0].shape
    codes, errors = [], []
    for rows in _slices(_matrix(column), entries * width):
        found = [nearest_entries(t, b, rows[:, p * width : (p + 1) * width]) for p, (t, b) in enumerate(zip(trees, books))]
        digits = np.stack([best for best, _ in found], axis=1)
        names = np.array([f"{i:02x}" for i in range(entries)])
        codes += ["".join(r) for r in names[digits]]
        errors.append(sum(e for _, e in found))
    return {"code": pa.array(codes, pa.string()), "error": pa.array(np.concatenate(errors) if errors else [], pa.int64())}


def integer_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows whose vector has no null and only finite components, with the integers floor(scale * x) as ``ints``."""
    x = F.col(f"`{vector}`")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    fits = F.forall(x, lambda v: F.abs(v) < LIMIT / scale)
    message = F.lit(f"a component is {LIMIT // scale} or larger in size: squared distances would not fit 64 bits")
    ints = F.when(fits, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))).otherwise(F.raise_error(message))
    kept = [F.col(f"`{c}`") for c in vectors.columns if c not in (vector, "ints")]
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(*kept, ints.alias("ints"))


def first_codebooks(held: DataFrame, id: str, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids, one of each id; those without an id come last."""
    one = held.groupBy(id).agg(F.min("ints").alias("ints"))
    rows = [r["ints"] for r in one.orderBy(F.asc_nulls_last(id)).limit(entries).collect()]
    if not rows:
        return []
    sizes = held.agg(F.min(F.size("ints")).alias("a"), F.max(F.size("ints")).alias("b")).first()
    if sizes["a"] != sizes["b"] or sizes["a"] % parts:
        raise ValueError(f"vectors have to be of one length, a multiple of {parts}; these have {sizes['a']} to {sizes['b']} components")
    seeds = np.array(rows, dtype=np.int64)
    width = seeds.shape[1] // parts
    return [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]


def vector_codes(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id``, ``code``, ``error``, ``label_error`` of every vector that is whole, and the final codebooks.

    A code has two hex digits for each part, the index of its nearest entry (ties: the lower one). ``error`` is the
    squared distance to the coded vector, ``label_error`` its sum over equal labels (rows without a label are
    one group). Vectors that are null, or hold a null or a component that is not finite, are left out. Repeated
    rows are each coded and each count in the sums; of rows that share an id the least vector is a seed, once. Fewer
    ids than ``entries`` make smaller codebooks. An entry that no part is nearest to stays. An empty table gives no rows and no
    codebooks. Components of 32,768 or more, and vectors of different lengths, are errors. Other columns are not read. The driver
    holds the codebooks alone, ``parts * entries`` pieces of a vector whatever the number of vectors.
    """
    source = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("embedding"))
    held = stored(integer_vectors(source))
    books = first_codebooks(held, "id", parts, entries)
    if not books:
        none = held.select(F.col("id").alias(id), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.filter("false"), []
    for _ in range(rounds):
        books = _moved(held, books)
    fields = [pa.field("code", pa.string()), pa.field("error", pa.int64())]
    coded = stored(with_text_columns(held, partial(_codes, books=books), fields, text="ints"))
    keyed = coded.withColumn("l", F.struct("label"))  # equal also where it is null
    sums = keyed.groupBy("l").agg(F.sum("error").alias("label_error"))
    out = lookup_join(keyed, stored(sums), ["l"], "inner", ["id"])
    return out.select(F.col("id").alias(id), "code", "error", "label_error"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()
