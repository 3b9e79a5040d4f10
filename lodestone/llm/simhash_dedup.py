"""Near-duplicates by SimHash: fingerprints, one-wildcard segment variants, and components.

A fingerprint is cut into so few segments that two fingerprints within the radius differ by at
most one bit in one of them (two segments at a radius of 3). The index holds each segment whole and once for
each of its bits with that bit deleted. Two fingerprints that agree in a whole segment meet there;
two that differ in one bit of it meet in the variant without this bit, from its two sides. Every pair is
met by equality alone, and then verified on all bits.

Many different fingerprints may share one segment. A key with more than ``FEW`` of them is
split: its fingerprints are keyed once more, by variants of segments of the other bits, which leaves at most
2 to the power of the bits not fixed. Inside a key only links that join what is still apart
are given out, so a group of near copies costs about as many links as it has members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import stored, with_text_columns
from lodestone.llm.components import components
from lodestone.operators.sizing import lookup_join, small_enough

BITS = 64
GRAM = 3
RADIUS = 3
SEED = 42
# Fingerprints of one key that are compared as they are; a key with more is split.
FEW = 4096
# Bytes of one text whose words are held at a time.
CHUNK_BYTES = 1 << 20
# Members of a key up to which all its pairs are looked at in one go with those of other keys.
SHORT = 64

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes, gram: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, a bounded run at a time."""
    lowered, at, words, found = text.lower(), 0, [], 0
    while at < len(lowered):
        stop = _BLANK.search(lowered, min(at + CHUNK_BYTES, len(lowered)))
        end = stop.start() if stop else len(lowered)
        words += lowered[at:end].split()
        at = end
        if len(words) >= gram:
            runs = [words[i:] for i in range(gram)]
            found = 1
            yield np.array([xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in zip(*runs)], dtype=np.uint64)
            words = words[len(words) - gram + 1 :]
    if not found and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)


def fingerprint_of(text: bytes, gram: int = GRAM) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; 0 for a text without words."""
    votes, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in _hashes(text, gram):
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _print_column(texts: pa.Array, gram: int) -> dict[str, pa.Array]:
    raw = texts.fill_null("").cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    return {"fp": pa.array([fingerprint_of(t.as_py(), gram) for t in raw], pa.int64())}


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def variants(bits: int, radius: int) -> list[tuple[int, int]]:
    """What each key keeps of a fingerprint, and the bit deleted from it (0: none), over the set ``bits``.

    The bits are cut into ``radius // 2 + 1`` segments, so that one of them differs by one bit at most.
    """
    places = [i for i in range(BITS) if bits >> i & 1]
    n = radius // 2 + 1
    found = []
    for s in range(n):
        own = places[len(places) * s // n : len(places) * (s + 1) // n]
        whole = sum(1 << i for i in own)
        found += [(whole, 0), *[(whole & ~(1 << i), 1 << i) for i in own]]
    return found


def _keyed(fps: DataFrame, keep: list[str], masks: list[tuple[int, int]], code: str, value: str) -> DataFrame:
    held = F.array(*[F.lit(_signed(m)).cast("long") for m, _ in masks])
    rows = fps.select(*keep, "fp", F.posexplode(held).alias(code, "_mask"))
    return rows.select(*keep, code, F.col("fp").bitwiseAND(F.col("_mask")).alias(value), "fp")


def _pairs_of_short(fp: np.ndarray, start: np.ndarray, size: np.ndarray, apart: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (places) within runs of few members, for all runs at once."""
    left = np.repeat(start + size, size) - np.arange(start[0], start[0] + size.sum()) if len(start) else np.zeros(0, np.int64)
    at = np.arange(len(left)) + (start[0] if len(start) else 0)
    firsts, seconds = [], []
    for step in range(1, int(size.max(initial=1))):
        a = at[left > step]
        differ = fp[a] ^ fp[a + step]
        hit = (np.bitwise_count(differ) <= radius) & (differ & apart[a] == apart[a])
        firsts.append(a[hit])
        seconds.append(a[hit] + step)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.zeros(0, np.int64),) * 2


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the pairs."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _reached(fp: np.ndarray, apart: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members of one run as far as they are linked, each member met once."""
    rest, firsts, seconds = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            differ = fp[rest] ^ fp[x]
            hit = (np.bitwise_count(differ) <= radius) & (differ & apart == apart)
            new, rest = rest[hit], rest[~hit]
            firsts.append(np.full(len(new), x))
            seconds.append(new)
            queue += list(new)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.zeros(0, np.int64),) * 2


def _links_of_runs(keys: list[np.ndarray], fp: np.ndarray, apart: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows in order of their keys; whole runs only."""
    new = np.ones(len(fp), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fp)))
    held = np.repeat((size > 1) & (size <= SHORT), size)
    short, kept = fp[held], size[(size > 1) & (size <= SHORT)]
    a, b = _pairs_of_short(short, np.cumsum(kept) - kept, kept, apart[held], radius)
    root = _forest(len(short), a, b)
    moved = np.flatnonzero(root != np.arange(len(short)))
    firsts, seconds = [short[root[moved]]], [short[moved]]
    for s, n in zip(start[size > SHORT], size[size > SHORT]):
        own = fp[s : s + n]
        a, b = _reached(own, apart[s], radius)
        firsts.append(own[a])
        seconds.append(own[b])
    return np.concatenate(firsts), np.concatenate(seconds)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch], masks: list[int], sub_masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key. A run that a batch cuts is carried on to the next."""
    deleted, below = np.array(masks, dtype=np.uint64), np.array([*sub_masks, 0], dtype=np.uint64)
    held: list[list[np.ndarray]] = []

    def give(rows: list[np.ndarray]) -> pa.RecordBatch:
        code, value, sub, sub_value, fp = rows
        a, b = _links_of_runs([code, value, sub, sub_value], fp.view(np.uint64), deleted[code] | below[sub], radius)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], schema=LINKS)

    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        if not len(rows[0]):
            continue
        last = np.flatnonzero(np.any([c != c[-1] for c in rows[:4]], axis=0))
        cut = last[-1] + 1 if len(last) else 0
        same = not held or all(c[0] == h[0] for c, h in zip(rows[:4], held[0][:4]))
        if cut == 0 and same:
            held.append(rows)
            continue
        ready = [*held, [c[:cut] for c in rows]]
        held = [[c[cut:] for c in rows]]
        yield give([np.concatenate(x) for x in zip(*ready)])
    if held:
        yield give([np.concatenate(x) for x in zip(*held)])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, few: int = FEW) -> DataFrame:
    """Pairs ``a``, ``b`` of different fingerprints (the long column ``fp``) that are linked, or joined by links of one key.

    They are fewer than all linked pairs, but have the same components: no two fingerprints within the radius
    are left apart, and none are joined that links do not join. Equal ones are one. An empty table has no pairs.
    """
    whole = (1 << BITS) - 1
    masks = variants(whole, radius)
    fps = stored(fps.select("fp").distinct())
    exact = [i for i, (_, gone) in enumerate(masks) if not gone]
    entries = _keyed(fps, [], masks, "code", "value")

    # a key without one bit holds no more than two whole segments do
    full = _keyed(fps, [], [masks[i] for i in exact], "s", "value")
    hot = stored(full.groupBy("s", "value").agg(F.count("*").alias("n")).filter(F.col("n") > few // 2).select("s", "value"))
    none = [F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_value")]
    parts, below = [], []
    if hot.isEmpty():
        parts.append(entries.select("code", "value", *none, "fp"))
    else:
        known = []
        for s, first in enumerate(exact):
            last = exact[s + 1] if s + 1 < len(exact) else len(masks)
            own = F.array(*[F.struct(F.lit(i).alias("code"), F.lit(_signed(masks[i][0])).cast("long").alias("m")) for i in range(first, last)])
            rows = hot.filter(F.col("s") == s).select("value", F.inline(own))
            known.append(rows.select("code", F.col("value").bitwiseAND(F.col("m")).alias("value")))
        split = known[0]
        for rows in known[1:]:
            split = split.unionByName(rows)
        split = stored(split.distinct())
        split = F.broadcast(split) if small_enough(split) else split
        parts.append(entries.join(split, ["code", "value"], "left_anti").select("code", "value", *none, "fp"))
        large = entries.join(split, ["code", "value"], "left_semi")
        for first, last in zip(exact, [*exact[1:], len(masks)]):
            own = variants(whole & ~masks[first][0], radius)
            rows = _keyed(large.filter(F.col("code").between(first, last - 1)), ["code", "value"], own, "sub", "sub_value")
            parts.append(rows.withColumn("sub", F.col("sub") + len(below)))
            below += own
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    keys = ["code", "value", "sub", "sub_value"]
    met = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    run = partial(_links, masks=[gone for _, gone in masks], sub_masks=[gone for _, gone in below], radius=radius)
    return met.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    Words are what blanks separate, A-Z lowered; a text of fewer words than ``gram`` is one shingle, repeated
    shingles vote each time, and a null text or one without words has the fingerprint zero, which is linked like any
    other. A text of any length is read whole, a bounded piece at a time. Equal texts have equal fingerprints; rows of equal
    fingerprints are linked. ``component_id`` is the smallest id reachable; rows that share an id
    are rows of their own, and rows without an id take part but are never a component's name (null if it has no
    other). An empty table gives none. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = docs.select(F.col(f"`{id}`").alias("node"), F.col(f"`{text}`").alias("text"))
    prints = stored(with_text_columns(rows, partial(_print_column, gram=gram), [pa.field("fp", pa.int64())]))
    classes = stored(prints.groupBy("fp").agg(F.min("node").alias("least")))
    found = components(fingerprint_links(classes, radius))
    of = classes.join(found.withColumnsRenamed({"node": "fp", "component": "_root"}), "fp", "left")
    of = stored(of.select("fp", "least", F.coalesce("_root", "fp").alias("_root")))
    heads = stored(of.groupBy("_root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    named = lookup_join(of, heads.withColumn("_joined", F.lit(True)), ["_root"], "left", ["fp"])
    table = stored(named.select("fp", F.when(F.col("_joined"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    out = lookup_join(prints, table, ["fp"], "inner", ["node"])
    return out.select(F.col("node").alias(id), F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint"), "component_id")
