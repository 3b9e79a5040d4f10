"""Shards by a k-d tree over the documents' metadata.

A node is split at the weighted median of its widest dimension, weights being bytes, until a
leaf holds no more than the target. A dimension is as wide as the share of all bytes between its least and
greatest value in the node. Medians come from histograms over all rows, refined a few
times; a node of any size is one row of a small aggregate for each cell. Rows that agree
in a dimension are parted by a hash, so a value that a third of all rows share can be cut.

Rows of one group (equal texts, say) have one place in every dimension, so no cut parts them. Groups of more than a
small part of a shard are dealt to the shards before, largest first, and the cuts make up for what they take; only a
group for which no shard has room left is cut, row by row. Only DataFrame functions are used.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.common import numbered, stored, without
from lodestone.operators.sizing import lookup_join

# Cells of a histogram, and how often the cell that holds the median is cut up again.
CELL_BITS = 12
REFINED = 4
_TOP = CELL_BITS * REFINED
# Bits of a dimension's place that its value decides; the rest is the hash.
_VALUE_BITS = 20
SHARDS = 8
# A group is dealt before the tree is made if it weighs more than this part of a shard.
HEAVY = 1 / 64


@dataclass
class Node:
    """A node of one level: the shards it is for, and the cut below which rows of ``dimension`` go left."""

    weight: int
    first: int
    leaves: int
    dimension: str | None = None
    cut: int = 0


def _unit_of(column: str) -> Column:
    """A place from 0 to 1 for a value that has no order to speak of; null is at 0."""
    return F.when(F.col(column).isNull(), 0.0).otherwise(F.pmod(F.xxhash64(column), F.lit(1 << 40)) / float(1 << 40))


def _place(unit: Column, low: float | None, high: float | None, own: Column) -> Column:
    """A whole number below 2^48: where a value lies from the least to the greatest (null is at the least), then a hash."""
    if low is None or high <= low:
        cell = F.lit(0).cast("long")
    else:
        share = F.coalesce((unit - F.lit(low)) / F.lit(high - low), F.lit(0.0))
        cell = F.least(F.floor(share * (1 << _VALUE_BITS)), F.lit((1 << _VALUE_BITS) - 1)).cast("long")
    return F.shiftleft(cell, _TOP - _VALUE_BITS) + F.pmod(own, F.lit(1 << (_TOP - _VALUE_BITS)))


def _ranks(rows: DataFrame, dimensions: list[str]) -> dict[str, list[float]]:
    """The weight before the middle of each cell of a dimension, over all rows."""
    cells = [F.struct(F.lit(d).alias("d"), F.shiftright(d, _TOP - CELL_BITS).alias("cell"), F.col("_weight").alias("w")) for d in dimensions]
    held = {d: [0] * (1 << CELL_BITS) for d in dimensions}
    for r in rows.select(F.inline(F.array(*cells))).groupBy("d", "cell").agg(F.sum("w").alias("w")).collect():  # dimensions x cells at most
        held[r["d"]][r["cell"]] = r["w"]
    return {d: [end - w / 2 for w, end in zip(ws, accumulate(ws))] for d, ws in held.items()}


def _widest(rows: DataFrame, ranks: dict[str, list[float]], live: dict[int, Node]) -> None:
    """Choose each node's dimension: the one between whose ends most of all weight lies, the first of equals."""
    ends = [f(d).alias(f"{d}_{n}") for d in ranks for n, f in (("lo", F.min), ("hi", F.max))]
    for r in rows.groupBy("_node").agg(*ends).collect():
        if r["_node"] in live:
            width = {d: of[r[f"{d}_hi"] >> (_TOP - CELL_BITS)] - of[r[f"{d}_lo"] >> (_TOP - CELL_BITS)] for d, of in ranks.items()}
            live[r["_node"]].dimension = max(ranks, key=width.get)


def _by_node(values: dict[int, Column], otherwise: Column) -> Column:
    """A column for each node."""
    out = None
    for node, value in values.items():
        test = F.col("_node") == node
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def _medians(rows: DataFrame, live: dict[int, Node], room: list[float]) -> None:
    """Find each node's cut: the place where the weight below is nearest to what its left shards have room for."""
    base = {n: 0 for n in live}
    wanted, at_cut = {}, {n: 0 for n in live}
    for n, node in live.items():
        own = room[node.first : node.first + node.leaves]
        left = sum(own[: node.leaves // 2]) / sum(own) if sum(own) > 0 else 0.5
        wanted[n] = node.weight * left
    before = {n: 0 for n in live}
    for turn in range(1, REFINED + 1):
        width = _TOP - CELL_BITS * turn
        place = _by_node({n: F.col(live[n].dimension) for n in live}, F.lit(None).cast("long"))
        low = _by_node({n: F.lit(b).cast("long") for n, b in base.items()}, F.lit(None).cast("long"))
        cell = F.floor((place - low) / F.lit(1 << width)).cast("long")
        inside = rows.withColumn("_cell", cell).filter(f"_cell >= 0 AND _cell < {1 << CELL_BITS}")
        cells: dict[int, list] = {}
        for r in inside.groupBy("_node", "_cell").agg(F.sum("_weight").alias("w")).collect():  # nodes x cells at most
            cells.setdefault(r["_node"], []).append((r["_cell"], r["w"]))
        for n in live:
            for at, w in sorted(cells.get(n, [])):
                at_cut[n] = w
                if before[n] + w >= wanted[n]:
                    base[n] += at << width
                    break
                before[n] += w
    for n, node in live.items():
        node.cut = base[n] + (2 * before[n] + at_cut[n] <= 2 * wanted[n])


def _dealt(heavy: list, room: list[float]) -> list[tuple]:
    """The shard of each heavy group, largest first into the shard with most room; those without room are left out."""
    free = [(-r, i) for i, r in enumerate(room)]
    heapq.heapify(free)
    out = []
    for *key, weight in heavy:
        left, shard = free[0]
        if -left >= weight:
            heapq.heapreplace(free, (left + weight, shard))
            room[shard] -= weight
            out.append((*key, shard))
    return out


def _with_groups(rows: DataFrame, keys: list[str], units: list[str], leaf: float, room: list[float]) -> DataFrame:
    """Rows with the hash and the least units of their group in place of their own, and ``_fixed``, the shard of a dealt group."""
    sums = [F.count("*").alias("_n"), F.sum("_weight").alias("_w"), *[F.min(u).alias(f"_least{u}") for u in units]]
    groups = stored(rows.groupBy(*keys).agg(*sums).filter("_n > 1"))
    # at most shards / HEAVY groups weigh so much
    heavy = groups.filter(F.col("_w") > HEAVY * leaf).select(*keys, "_w").orderBy(F.desc("_w"), *keys).collect()
    dealt = _dealt([tuple(r) for r in heavy], room)
    schema = ", ".join([*[f"{k} long" for k in keys], "_fixed int"])
    held = groups.join(F.broadcast(rows.sparkSession.createDataFrame(dealt, schema)), keys, "left")
    whole = (F.col("_w") <= HEAVY * leaf) | F.col("_fixed").isNotNull()
    held = stored(held.filter(whole).select(*keys, "_fixed", *[f"_least{u}" for u in units], F.lit(True).alias("_whole")))
    joined = lookup_join(rows, held, keys, "left", ["_self"])
    own = F.when(F.col("_whole"), F.xxhash64(*keys)).otherwise(F.col("_self"))
    return joined.withColumns({"_self": own, **{u: F.coalesce(f"_least{u}", u) for u in units}})


def kd_shards(
    docs: DataFrame,
    dimensions: dict[str, Column],
    weight: Column,
    identity: list[str],
    shards: int | None = SHARDS,
    target: int | None = None,
    group: Sequence[Column] = (),
) -> DataFrame:
    """Every row with ``shard``, numbered from 0, and ``slot``, its number there from 0.

    ``dimensions`` are places from 0 to 1 by name (null counts as the least), ``weight`` is a row's bytes (at least 1),
    and ``identity`` are the columns that tell rows apart; rows that agree in them may be
    swapped. Rows that agree in the ``group`` columns (whole numbers; a null makes no group) share a shard, unless they
    weigh more than any shard has room for. Give the number of shards, or a ``target`` weight, from which the number follows
    (leaves are split while they are heavier). Columns of the names added are replaced, others kept. An empty
    table gives no rows. The columns given are stored once or twice and read a few times for
    each level, so leave texts out.
    """
    base = without(docs, ["shard", "slot"])
    units, places, keys = [[f"{p}{i}" for i in range(len(of))] for p, of in (("_u", dimensions), ("_d", dimensions), ("_g", group))]
    rows = base.select(
        F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"),
        *[c.cast("double").alias(u) for u, c in zip(units, dimensions.values())],
        *[c.cast("long").alias(k) for k, c in zip(keys, group)],
        weight.cast("long").alias("_weight"),
        F.xxhash64(*[F.col(f"`{c}`") for c in identity]).alias("_self"),
    )
    rows = stored(rows)
    ends = [f(u).alias(f"{u}_{n}") for u in units for n, f in (("lo", F.min), ("hi", F.max))]
    seen = rows.agg(F.coalesce(F.sum("_weight"), F.lit(0)).alias("w"), *ends).first()
    total = seen["w"]
    if target is not None:
        shards = max(1, math.ceil(total / target))
    room = [total / shards] * shards
    if keys:
        rows = _with_groups(rows, keys, units, total / shards, room)
    else:
        rows = rows.withColumn("_fixed", F.lit(None).cast("int"))
    # places in one range, so that widths compare
    at = [_place(F.col(u), seen[f"{u}_lo"], seen[f"{u}_hi"], F.xxhash64(F.lit(i), "_self")) for i, u in enumerate(units)]
    rows = stored(rows.select("_row", "_weight", "_fixed", *[c.alias(d) for d, c in zip(places, at)]))
    deep = rows.filter("_fixed IS NULL").withColumn("_node", F.lit(0))
    free = deep.agg(F.coalesce(F.sum("_weight"), F.lit(0)).alias("w")).first()["w"]
    ranks = _ranks(deep, places)
    level = {0: Node(free, 0, shards)}
    while any(n.leaves > 1 and n.weight for n in level.values()):
        live = {k: n for k, n in level.items() if n.leaves > 1 and n.weight}
        _widest(deep, ranks, live)
        _medians(deep, live, room)
        below = {k: (2 * k + 1) + F.when(F.col(n.dimension) < n.cut, 0).otherwise(1) for k, n in live.items()}
        deep = deep.withColumn("_node", _by_node(below, F.col("_node") * 2 + 1))
        weights = {r["_node"]: r["w"] for r in deep.groupBy("_node").agg(F.sum("_weight").alias("w")).collect()}
        after: dict[int, Node] = {}
        for k, n in level.items():
            left = n.leaves // 2 if k in live else n.leaves
            after[2 * k + 1] = Node(weights.get(2 * k + 1, 0), n.first, left)
            if k in live:
                after[2 * k + 2] = Node(weights.get(2 * k + 2, 0), n.first + left, n.leaves - left)
        level = after
    shard = _by_node({k: F.lit(n.first) for k, n in level.items()}, F.lit(0)).cast("int")
    fixed = rows.filter("_fixed IS NOT NULL").select("_row", F.col("_fixed").alias("shard"))
    placed = deep.select("_row", shard.alias("shard")).unionByName(fixed)
    out = numbered(placed, ["shard"], [f"_row.`{c}`" for c in identity], "slot")
    return out.select("_row.*", "shard", "slot")


def document_dimensions(source: str = "source", lang: str = "lang", size: str = "size") -> dict[str, Column]:
    """Places of documents: by source, by language, and by the logarithm of their size."""
    return {"source": _unit_of(source), "lang": _unit_of(lang), "size": F.least(F.log2(F.col(size).cast("double")) / 40, F.lit(1.0))}
