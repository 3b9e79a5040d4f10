"""Documents whose sets of word n-grams have a Jaccard similarity of at least a bound.

The join is a sparse product of the document-by-n-gram matrix with itself, cut into blocks so
that pairs below the bound hardly ever meet. Two sets of sizes up to U that reach the bound
differ in at most D n-grams, which follows from the sizes alone. If all n-grams are
dealt by their hash to D + 1 parts, two such sets agree in one part entirely. A block is
therefore a part together with all that a document holds of it; documents meet only
within a block. For small sets (D up to 1) a block is the set, whole or without one of its n-grams.
An n-gram that many documents share thus makes no large block by itself.

Documents with equal sets are one class. Every class is first held against one head of its blocks, the class that shares most; that
joins most groups. In blocks whose members are still in several components these are compared with each other, all in one task if the block has
a bounded number of members; in a larger one every class is held against the head. Only pairs whose sketches differ in few enough bits are compared by
their sets: a sketch has the parity of the number of n-grams on each of its bits, so it never differs in more bits than the sets in n-grams. Where the members of a head are still in
several components, the product is repeated over what sets them apart from the head: two
members x and y of head h differ in as many n-grams as x ^ h and y ^ h do, so unless one
component holds both, these differences must overlap by a bound that again follows from the
sizes. Rare n-grams come first in them, and only prefixes that the bound leaves are joined. So a
group of near copies costs about as many comparisons as it has members, and yet every linked
pair ends in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import parts_for, stored, with_text_columns
from lodestone.llm.components import components
from lodestone.llm.wordhash import UNSPACED, lists, mix, slices, words_of
from lodestone.operators.sizing import small_enough

GRAM = 3
# The bound, as percent.
PERCENT = 90
# Sizes in one class differ by this factor at most.
SIZE_STEP = 1.4
# Words of 64 bits of the smallest sketch, and n-grams for each word of a larger one (a power of two). Two sets differ in
# at least as many n-grams as their sketches in bits.
SKETCH_WORDS = 16
SKETCH_STEP = 32
# Members of a block up to which one task compares them by their sketches; a larger one goes by its head.
PAIRED = 512
# Up to this difference a block is a set without one member. With 2 it would not do: a set and
# the same with two more members share no such block.
FEW = 1

SETS = [pa.field("n_shingles", pa.int64()), pa.field("k1", pa.int64()), pa.field("k2", pa.int64())]
BLOCKS = [*SETS, pa.field("sketch", pa.list_(pa.int64())), pa.field("blocks", pa.list_(pa.int64()))]
GRAMS = [*SETS, pa.field("grams", pa.list_(pa.int64()))]


def _salted(x: np.ndarray, salt) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x ^ (np.asarray(salt, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))


@lru_cache
def _size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the size classes; difference bound, parts and spare parts of each.

    The spare parts make up for parts that are empty, which agree without meaning: with e of
    them at least e + 1 parts agree.
    """
    step = max(SIZE_STEP, 100 / percent)
    lower = [1, 2]
    while lower[-1] < 1 << 40:
        lower.append(max(lower[-1] + 1, 100 * (lower[-1] - 1) // percent + 1, int(step * lower[-1])))
    differ, parts, spare = [], [], []
    for low, high in zip(lower, lower[1:]):
        # |x| + |y| = s and the bound give an overlap of p s / (100 + p), so a difference of
        # s - 2 overlaps
        d = (100 - percent) * 2 * (high - 1) // (100 + percent)
        empty = (d + 1) * (1 - 1 / (d + 1)) ** low  # parts expected empty at the smallest size
        e = 8 + 2 * int(empty) if empty > 0.1 else next(e for e in range(10) if empty ** (e + 1) < 1e-9)
        differ.append(d)
        spare.append(e)
        parts.append(d + 1 + e)
    return tuple(np.array(x, dtype=np.int64) for x in (lower, differ, parts, spare))


def _sets(raw: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: number of the text, hash; and how many."""
    n = len(offsets) - 1
    words = words_of(raw, offsets, UNSPACED)
    counts = words.counts
    texts, hashes = [], []
    for k in range(1, gram + 1):  # fewer words than an n-gram: all of them as one
        own = counts[words.text] >= gram if k == gram else counts[words.text] == k
        at = np.flatnonzero(own & (words.left() >= k))
        texts.append(words.text[at])
        hashes.append(words.runs(k, at))
    text = np.concatenate(texts).astype(np.uint16)
    hashed = np.concatenate(hashes)
    order = np.argsort(hashed)
    order = order[np.argsort(text[order], kind="stable")]
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    text, hashed = text[new].astype(np.int64), hashed[new]
    return text, hashed, np.bincount(text, minlength=n)


def _sum_by(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.uint64)
    np.add.at(out, place, values)
    return out


def _blocks(text: np.ndarray, hashed: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each text: number of the text, hash of the block; in order of the texts."""
    lower, differ, parts, spare = _size_classes(percent)
    own = np.searchsorted(lower, sizes, "right") - 1
    partner = np.searchsorted(lower, 100 * sizes // percent, "right") - 1
    filled = sizes > 0
    texts, blocks = [], []

    small = filled & ((differ[own] <= FEW) | (differ[partner] <= FEW))
    if small.any():
        marks = _salted(hashed, 1)
        total = _sum_by(text, marks, len(sizes))
        whole = np.flatnonzero(small)
        rows = small[text]
        texts += [whole, text[rows]]
        blocks += [_salted(total[whole], 2), _salted(total[text[rows]] - marks[rows], 2)]

    for classes, wanted in ((own, filled), (partner, filled & (partner > own))):
        wanted = wanted & (differ[classes] > FEW)
        if not wanted.any():
            continue
        rows = wanted[text]
        t, h = text[rows], hashed[rows]
        level = np.where(wanted, classes, 0)
        many = np.where(wanted, parts[level], 0)
        base = np.cumsum(many) - many
        total = int(many.sum())
        place = base[t] + (_salted(h, 3 + level[t]) % many[t].astype(np.uint64)).astype(np.int64)
        held = np.bincount(place, minlength=total)
        sums = _sum_by(place, _salted(h, 1), total)
        of = np.repeat(np.arange(len(sizes)), many)
        empty = np.bincount(of[held == 0], minlength=len(sizes))
        # a text with more empty parts than spare ones has to meet its like in empty ones
        use = (held > 0) | (empty > np.where(wanted, spare[level], 0))[of]
        part = np.arange(total) - base[of]
        texts.append(of[use])
        blocks.append(_salted(_salted(sums[use], 1000 + part[use]), 3 + level[of[use]]))

    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, block = np.concatenate(texts), np.concatenate(blocks)
    order = np.argsort(text, kind="stable")
    return text[order], block[order]


def _sketches(text: np.ndarray, hashed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an even or odd number of a text's n-grams falls on each bit, as words end to end; and their number for each text.

    Half a sketch laid over the other half is the sketch of half the size.
    """
    words = np.maximum(SKETCH_WORDS, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / SKETCH_STEP)).clip(0).astype(np.int64))
    out = np.zeros(int(words.sum()), dtype=np.uint64)
    bit = _salted(hashed, 21)
    word = ((bit >> np.uint64(6)) & (words[text] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, (np.cumsum(words) - words)[text] + word, np.uint64(1) << (bit & np.uint64(63)))
    return out, words


def _columns(texts: pa.Array, gram: int, percent: int, grams: bool) -> dict[str, pa.Array]:
    fields, parts = GRAMS if grams else BLOCKS, []
    for raw, offsets in slices(texts):
        n = len(offsets) - 1
        text, hashed, sizes = _sets(raw, offsets, gram)
        keys = [_sum_by(text, _salted(hashed, salt), n).view(np.int64) for salt in (11, 12)]
        made = [pa.array(sizes, pa.int64()), *map(pa.array, keys)]
        if grams:
            many, values = sizes, hashed
        else:
            of, values = _blocks(text, hashed, sizes, percent)
            many = np.bincount(of, minlength=n)
            sketch, words = _sketches(text, hashed, sizes)
            made.append(lists(sketch.view(np.int64), words, pa.int64()))
        parts.append([*made, lists(values.view(np.int64), many, pa.int64())])
    if not parts:
        return {f.name: pa.array([], f.type) for f in fields}
    return {f.name: pa.concat_arrays(list(x)) for f, x in zip(fields, zip(*parts))}


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` with their sets ``x``, ``y`` and the size of the overlap."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(right, "b").join(left, "a").withColumn("overlap", F.size(F.array_intersect("x", "y")))


def _reaches(percent: int):
    return 100 * F.col("overlap") >= percent * (F.size("x") + F.size("y") - F.col("overlap"))


def _sent(table: DataFrame) -> DataFrame:
    """A table that is broadcast if it is measured to be small."""
    return F.broadcast(table) if small_enough(table) else table


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose sketches and sizes leave them the chance to reach the bound."""
    left = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("m"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("sketch").alias("y"))
    # sets of like sizes have sketches of one size, or one of twice the other's
    w = F.least(F.size("x"), F.size("y"))
    folded = [F.when(F.size(c) > w, F.zip_with(F.slice(c, F.lit(1), w), F.slice(c, w + 1, w), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(c)) for c in "xy"]
    bits = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, d: total + d)
    sizes = (100 * F.col("m") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("m"))
    alike = bits * (100 + percent) <= (100 - percent) * (F.col("m") + F.col("n"))
    return pairs.join(left, "a").join(right, "b").filter(sizes).filter(alike).select("a", "b")


def _sets_of(docs: DataFrame, text: str, gram: int, percent: int, parts: int, nodes: DataFrame) -> DataFrame:
    """The n-grams of some nodes, worked out anew from their texts."""
    own = docs.join(_sent(stored(nodes, parts)), "node", "left_semi")
    grams = with_text_columns(own, partial(_columns, gram=gram, percent=percent, grams=True), GRAMS, text)
    return stored(grams.dropDuplicates(["node", "n_shingles", "k1", "k2"]).select("node", "grams"), parts)


def _linked(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, parts: int) -> DataFrame:
    """The pairs that reach the bound by their sets."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return stored(_with_sets(pairs, sets(nodes)).filter(_reaches(percent)).select("a", "b"), parts)


def _near_in_blocks(batches: Iterator[pa.RecordBatch], percent: int, closest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one block, in different components, whose sketches and sizes leave them the chance to reach the bound.

    ``closest``: of each two components only the pair whose sketches differ least. Rows come in order of their block, which has a bounded number of them; one that a batch cuts is carried on.
    """

    def pairs(node, component, size, sketch):
        x, y = np.triu_indices(len(node), 1)
        other = component[x] != component[y]
        x, y = x[other], y[other]
        fits = (100 * size[x] >= percent * size[y]) & (100 * size[y] >= percent * size[x])
        x, y = x[fits], y[fits]
        bits = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        alike = bits * (100 + percent) <= (100 - percent) * (size[x] + size[y])
        x, y, bits = x[alike], y[alike], bits[alike]
        if closest and len(x):
            ends = np.sort(np.stack([component[x], component[y]]), axis=0)
            order = np.lexsort((bits, ends[1], ends[0]))
            ends = ends[:, order]
            first = np.append(True, (ends[:, 1:] != ends[:, :-1]).any(axis=0))
            x, y = x[order[first]], y[order[first]]
        x, y = node[x], node[y]
        return np.minimum(x, y), np.maximum(x, y)

    def matrix(own):
        """Sketches of one size, the smallest there is."""
        w = min(map(len, own))
        return np.stack([np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) for x in own])

    def give(parts):
        block, node, component, size = [np.concatenate(c) for c in zip(*[p[:4] for p in parts])]
        sketch = [x for p in parts for x in p[4]]
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        found = [pairs(*[c[i:j] for c in (node, component, size)], matrix(sketch[i:j])) for i, j in zip(edges, np.append(edges[1:], len(block)))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns[:4]]
        if not len(rows[0]):
            continue
        ends = np.cumsum(np.asarray(batch.column(4).value_lengths()))
        rows.append(np.split(np.asarray(batch.column(4).flatten()).view(np.uint64), ends[:-1]))
        last = np.flatnonzero(rows[0] != rows[0][-1])
        cut = last[-1] + 1 if len(last) else 0
        if cut or held and held[-1][0][-1] != rows[0][0]:
            yield give([*held, [c[:cut] for c in rows]])
            held = []
        held.append([c[cut:] for c in rows])
    if held:
        yield give(held)


def _apart(tried: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one head, in different components, that can still reach the bound."""
    of = tried.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    of = of.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    of = of.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    mixed = of.groupBy("a").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi"), F.count("*").alias("n"))
    mixed = mixed.filter("n > 1 AND lo < hi").select("a")  # else no two members are apart
    rows = _with_sets(of.join(mixed, "a", "left_semi"), sets)
    # rare ones first: what the head does not have
    rows = rows.select(
        "a", "b", "cb", F.size("y").alias("size"), F.concat(F.array_sort(F.array_except("y", "x")), F.array_sort(F.array_except("x", "y"))).alias("other")
    ).withColumn("d", F.size("other"))
    loose, whole = 100 - percent, 100 + percent
    # a partner is at most 100 / percent as large, and differs from the head by d - most at least
    most = F.floor(F.col("size") * (100 + percent) / percent) * loose / whole
    needed = F.ceil((F.col("d") + F.greatest(F.lit(1), F.col("d") - most) - most) / 2)
    prefix = (F.col("d") - F.greatest(F.lit(1), needed) + 1).cast("int")
    entries = rows.filter(prefix > 0).select("a", "b", "cb", "size", "d", F.posexplode(F.slice("other", F.lit(1), prefix)).alias("at", "gram"))
    x, y = entries.alias("x"), entries.alias("y")
    allowed = F.floor((F.col("x.size") + F.col("y.size")) * loose / whole)
    overlap = F.greatest(F.lit(1), F.ceil((F.col("x.d") + F.col("y.d") - allowed) / 2))
    meets = (
        (F.col("x.a") == F.col("y.a"))
        & (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.b") < F.col("y.b"))
        & (F.col("x.cb") != F.col("y.cb"))
        & (F.col("x.at") <= F.col("x.d") - overlap)
        & (F.col("y.at") <= F.col("y.d") - overlap)
        & (100 * F.col("x.size") >= percent * F.col("y.size"))
        & (100 * F.col("y.size") >= percent * F.col("x.size"))
    )
    return x.join(y, meets).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()


def class_components(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (id, size, key of the set) and the component of every linked id."""
    blocked = with_text_columns(docs.select(F.col(id).alias("node"), text), partial(_columns, gram=gram, percent=percent, grams=False), BLOCKS, text)
    blocked = stored(blocked)
    parts = parts_for(blocked)
    kept = partial(stored, parts=parts)
    rows = blocked.drop("blocks", "sketch")
    keys = ["k1", "k2", "n_shingles"]
    known = rows.filter("node IS NOT NULL AND n_shingles > 0")
    classes = kept(known.groupBy(*keys).agg(F.min("node").alias("node"), F.count("*").alias("_n")))
    copies = known.join(classes.filter("_n > 1").select(*keys, F.col("node").alias("first")), keys).filter("node <> first")
    copies = kept(copies.select("node", *keys, "first"))

    # one of each class
    firsts = blocked.filter("node IS NOT NULL AND n_shingles > 0").join(_sent(copies.select("node", *keys)), ["node", *keys], "left_anti")
    entries = firsts.select("node", F.explode("blocks").alias("block"))
    shared = entries.groupBy("block").agg(F.count("*").alias("many")).filter("many > 1")
    members = kept(entries.join(shared, "block"))

    # each class first against one other: of those that lead its blocks by sharing most, the first
    reach = members.groupBy("node").agg(F.sum(F.col("many") - 1).alias("reach"))
    heads = members.join(reach, "node").groupBy("block").agg(F.max(F.struct("reach", "node")).alias("h"))
    led = members.join(heads, "block").filter(F.col("h.node") != F.col("node"))
    hubs = led.groupBy("node").agg(F.max("h").alias("h")).select(F.col("h.node").alias("a"), F.col("node").alias("b"))
    sketches = kept(firsts.dropDuplicates(["node"]).select("node", "n_shingles", "sketch"))
    kind = members.schema["node"].dataType.simpleString()
    sets = partial(_sets_of, docs.select(F.col(id).alias("node"), text), text, gram, percent, parts)
    links = _linked(kept(_alike(hubs, sketches, percent)), sets, percent, parts)

    # then in blocks whose classes are still apart: all in a block of bounded size, at first only the closest pair of two components
    for closest in (True, False):
        known = members.join(kept(components(links, parts)), "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = known.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("block")
        known = kept(known.join(mixed, "block", "left_semi").select("block", "many", "node", "component"))
        held = known.filter(F.col("many") <= PAIRED).join(sketches, "node").select("block", "node", "component", "n_shingles", "sketch")
        held = held.repartition("block").sortWithinPartitions("block")
        near = held.mapInArrow(partial(_near_in_blocks, percent=percent, closest=closest), f"a {kind}, b {kind}").distinct()
        if closest:
            links = links.unionByName(_linked(kept(near), sets, percent, parts))

    # in a larger one, those that its head is like
    led = known.filter(F.col("many") > PAIRED).join(heads.select("block", F.col("h.node").alias("head")), "block").filter("node <> head")
    led = kept(led.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    more = kept(near.unionByName(_alike(led, sketches, percent)))
    links = links.unionByName(_linked(more, sets, percent, parts))

    # and last what is still apart in the larger ones
    if not led.isEmpty():
        wanted = led.select(F.col("a").alias("node")).unionByName(led.select(F.col("b").alias("node"))).distinct()
        own = sets(wanted)
        rest = kept(_alike(_apart(led, components(links, parts), own, percent), sketches, percent))
        links = links.unionByName(_with_sets(rest, own).filter(_reaches(percent)).select("a", "b"))
    same = copies.select(F.col("first").alias("a"), F.col("node").alias("b"))
    return rows, components(links.unionByName(same), parts)


def ngram_components(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` and ``component_id``.

    Words are what blanks separate, A-Z lowered; fewer than ``gram`` words are one shingle, and
    a null text or one without words has none and is linked with nothing. Rows that share an
    id are one node. A row without an id belongs to no component (null). Other columns of
    ``docs`` are not read.
    """
    rows, found = class_components(docs, id, text, gram, percent)
    of = found.select(F.col("node"), F.col("component").alias("_component"))
    out = rows.join(of, "node", "left")
    return out.select(F.col("node").alias(id), "n_shingles", F.coalesce("_component", "node").alias("component_id"))


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does, the one of the smallest id.

    Rows that share an id are one document, of which one row stays (the one of the smallest
    text hash). Rows without an id stay as they are.
    """
    rows, found = class_components(docs, id, text, gram, percent)
    go = found.filter("node <> component").select(F.col("node").alias(id))
    left = docs.join(go, id, "left_anti")
    twice = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("node").alias(id))
    if not twice.take(1):
        return left
    once = left.join(twice, id, "left_semi").withColumn("_h", F.xxhash64(text))
    smallest = once.groupBy(id).agg(F.min("_h").alias("_h"))
    kept = once.join(smallest, [id, "_h"], "left_semi").dropDuplicates([id]).drop("_h")
    return left.join(twice, id, "left_anti").unionByName(kept.select(*left.columns))
