"""Repair of a conversation's structure by weighted interval parsing.

The wanted order of roles, ``(s?(ua)+)?``, is a grammar in Chomsky normal form over spans of rows. Its
nonterminals N(p, q) say that a span, edited, leads from place p of the pattern to place q, and the
rules are N(p, q) -> N(p, r) N(r, q). A row is a terminal of N(p, q) as kept, given another role or
deleted; an inserted row needs no row of the span, so insertions are closed over at every single row. The
cell of a span holds for each nonterminal the least (cost, audit): fewest cost, then the
ASCII-least edits. Two different ways of the same cost through one span never begin one with the other, since the rest
would be insertions, which cost; so the least audit of two neighbouring spans is that of the left followed by that of the right.

Cells are combined bottom-up by span length. Because the grammar has a rule for every place r, a
span is derived through any of its cuts at the same cost, so of the spans of one length only
neighbours of a bracketing are needed, and equal runs of rows share a cell. Conversations are cut into blocks of bounded
length that are parsed in different tasks, and blocks into groups of blocks until one is left, so a
conversation of any length is parsed by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.common import stored
from lodestone.operators.ordering import with_sequence
from lodestone.operators.sizing import lookup_join

# What edits cost.
REROLE, DELETE, INSERT, MEND = 3, 4, 3, 3

# Rows of one block, and blocks or groups that are combined at a time.
BLOCK = 256
FAN = 64
# Output rows of one batch.
BATCH = 50_000

# Places of the pattern: before all, after the system row, after a user's, after an assistant's.
_PLACES = range(4)
_STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_ENDS = (0, 3)
# A row as one character: its role's initial (s, u, a or another), then its fault (none, to be deleted, truncated).
_INITIALS = "sua-"
_SOUND, _GONE, _CUT = range(3)
_CODES = "ABCDEFGHIJKL"

Cell = dict[tuple[int, int], tuple[int, str]]


def _add(cell: Cell, key: tuple[int, int], way: tuple[int, str]) -> None:
    if key not in cell or way < cell[key]:
        cell[key] = way


def _joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in _PLACES:
            if (r, q) in right:
                more, rest = right[r, q]
                total = cost + more
                if (p, q) not in out or total <= out[p, q][0]:
                    _add(out, (p, q), (total, audit + rest))
    return out


@lru_cache
def _inserted() -> Cell:
    """Ways between places by insertions alone."""
    one: Cell = {(p, p): (0, "") for p in _PLACES}
    for (role, p), q in _STEPS.items():
        if role != "s":
            _add(one, (p, q), (INSERT, "I"))
    closed = one
    while (wider := _joined(closed, one)) != closed:
        closed = wider
    return closed


@lru_cache
def _row_cell(code: str) -> Cell:
    """The ways of one row, with insertions on both sides."""
    initial, fault = _INITIALS[_CODES.index(code) // 3], _CODES.index(code) % 3
    cell: Cell = {(p, p): (DELETE, "D") for p in _PLACES}
    if fault != _GONE:
        mend = MEND if fault == _CUT else 0
        for (role, p), q in _STEPS.items():
            if role == initial:
                _add(cell, (p, q), (mend, "K"))
            if role != "s":
                _add(cell, (p, q), (REROLE + mend, "R"))
    return _joined(_joined(_inserted(), cell), _inserted())


def _combined(cells: list[Cell]) -> Cell:
    """One cell of neighbouring spans, by doubling lengths."""
    while len(cells) > 1:
        odd = cells[-1:] if len(cells) % 2 else []
        cells = [_joined(a, b) for a, b in zip(cells[::2], cells[1::2])] + odd
    return cells[0]


@lru_cache(maxsize=4096)
def span_cell(codes: str) -> Cell:
    """The cell of a run of rows; equal runs are parsed once."""
    if len(codes) == 1:
        return _row_cell(codes)
    cells: dict[str, Cell] = {}
    spans = list(codes)
    for c in set(spans):
        cells[c] = _row_cell(c)
    while len(spans) > 1:
        wider = []
        for a, b in zip(spans[::2], spans[1::2]):
            if a + b not in cells:
                cells[a + b] = _joined(cells[a], cells[b])
            wider.append(a + b)
        spans = wider + (spans[-1:] if len(spans) % 2 else [])
    return cells[spans[0]]


def _rows_of(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cell.items())]


_CELL = "array<struct<p: int, q: int, cost: bigint, audit: string>>"
_ARROW_CELL = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's codes become its cell."""
    for batch in batches:
        cells = [_rows_of(span_cell(c)) for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, _ARROW_CELL)], names=["conv", "block", "cell"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of neighbouring cells become one cell each."""
    for batch in batches:
        for i in range(len(batch)):
            parts = [{(w["p"], w["q"]): (w["cost"], w["audit"]) for w in cell} for cell in batch.column(2)[i].as_py()]
            cell = pa.array([_rows_of(_combined(parts))], _ARROW_CELL)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], cell], names=["conv", "block", "cell"])


_EDITS = pa.schema([("conv", pa.string()), ("at", pa.int64()), ("pos", pa.int64()), ("role", pa.string())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that come out: place, the row they come from (null: inserted), and the role they get (null: their own)."""
    for batch in batches:
        audits = batch.column(1).to_pylist()
        ops = np.frombuffer("".join(audits).encode(), dtype=np.uint8)
        sizes = np.array([len(a) for a in audits], dtype=np.int64)
        of = np.repeat(np.arange(len(audits)), sizes)
        out, old = ops != ord("D"), ops != ord("I")
        lengths = np.bincount(of[out], minlength=len(audits))
        at = np.cumsum(out) - 1 - (np.cumsum(lengths) - lengths)[of]
        held = np.bincount(of[old], minlength=len(audits))
        pos = np.cumsum(old) - 1 - (np.cumsum(held) - held)[of]
        # a system row comes first if the number is odd; users and assistants take turns
        user = (at - lengths[of] % 2) % 2 == 0
        chosen = np.flatnonzero(out)
        for first in range(0, len(chosen), BATCH):
            own = chosen[first : first + BATCH]
            names = pa.array(["assistant", "user"]).take(pa.array(user[own].astype(np.int64)))
            roles = pc.if_else(pa.array(ops[own] == ord("K")), pa.scalar(None, pa.string()), names)
            columns = [batch.column(0).take(pa.array(of[own])), pa.array(at[own]), pa.array(pos[own], mask=~old[own]), roles]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _EDITS)], schema=_EDITS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which come in order, joined by line breaks; lines are not kept."""
    schema = pa.schema([("conv", pa.string()), ("digest", pa.string())])
    current, running = None, None
    for batch in batches:
        names, digests = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if conv != current:
                if running is not None:
                    names.append(current)
                    digests.append(running.hexdigest())
                current, running = conv, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([running.hexdigest()])], schema=schema)


def conversation_key(conv: Column) -> Column:
    """A conversation's id as text; rows without one are one conversation, a space."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in order (``conv``, ``turn``, ``role``, ``text``) with ``pos`` from 0 in each conversation and their first ``fault``.

    Nulls come first among turns; rows of one turn are in order of role and text.
    """
    placed = stored(with_sequence(rows, ["turn", "role", "text"], "seq", ["conv"]).withColumn("pos", F.col("seq") - 1).drop("seq"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keys = [F.xxhash64(F.lit(i), "role", "text").alias(f"k{i}") for i in range(2)]
    named = placed.select("*", *keys)
    # only those that come more than once
    firsts = named.groupBy("conv", "k0", "k1").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = lookup_join(named, stored(firsts), ["conv", "k0", "k1"], "left", ["pos"])
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~whole, "truncated")
    return known.select("conv", "turn", "role", "text", "pos", fault.alias("fault"))


def repair_plans(rows: DataFrame) -> DataFrame:
    """``conv``, ``cost``, ``audit`` and ``illegal`` of every conversation of rows with faults."""
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("role").rlike("^[sua]"), F.instr(F.lit(_INITIALS), initial) - 1).otherwise(3)
    fault = F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(F.col("fault") == "truncated", _CUT).otherwise(_SOUND)
    code = F.substring(F.lit(_CODES), (3 * kind + fault + 1).cast("int"), F.lit(1))
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    coded = rows.select("conv", block, F.struct("pos", code.alias("code"), initial.alias("initial")).alias("row"))
    # at most BLOCK rows each
    held = coded.groupBy("conv", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    pairs = F.transform(
        F.sequence(F.lit(2), F.size("rows")), lambda i: F.concat(F.element_at("rows", i - 1).initial, F.element_at("rows", i).initial)
    )
    bad = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))
    blocks = stored(
        held.select(
            "conv",
            "block",
            F.array_join(F.transform("rows", lambda r: r.code), "").alias("codes"),
            F.when(F.size("rows") > 1, bad).otherwise(0).alias("illegal"),
            F.element_at("rows", 1).initial.alias("head"),
            F.element_at("rows", -1).initial.alias("tail"),
        )
    )
    after = blocks.select("conv", (F.col("block") + 1).alias("block"), F.col("tail").alias("before"))
    cuts = blocks.filter("block > 0").join(after, ["conv", "block"])
    cuts = cuts.select("conv", F.concat("before", "head").isin("su", "ua", "au").alias("fine")).filter("NOT fine")
    illegal = blocks.select("conv", "illegal").unionByName(cuts.select("conv", F.lit(1).alias("illegal")))
    illegal = illegal.groupBy("conv").agg(F.sum("illegal").alias("illegal"))

    cells = stored(blocks.select("conv", "block", "codes").mapInArrow(_parse_blocks, f"conv string, block long, cell {_CELL}"))
    ready = cells
    most = cells.agg(F.max("block").alias("b")).first()["b"] or 0
    while most:  # one round for each factor of FAN in the longest conversation
        up = F.floor(F.col("block") / FAN).alias("block")
        group = cells.select("conv", up, F.struct("block", "cell").alias("c")).groupBy("conv", "block").agg(F.array_sort(F.collect_list("c")).alias("c"))
        single = group.filter("size(c) = 1").select("conv", "block", F.col("c")[0].cell.alias("cell"))
        more = group.filter("size(c) > 1").select("conv", "block", F.transform("c", lambda x: x.cell).alias("c"))
        wider = more.mapInArrow(_join_blocks, f"conv string, block long, cell {_CELL}")
        cells = stored(single.unionByName(wider))
        ready, most = cells, most // FAN
    ways = F.filter("cell", lambda w: (w.p == 0) & w.q.isin(*_ENDS))
    least = F.array_min(F.transform(ways, lambda w: F.struct(w.cost.alias("cost"), w.audit.alias("audit"))))
    return ready.select("conv", least.alias("least")).select("conv", "least.*").join(illegal, "conv")


def repaired_lines(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv``, ``at``, ``role``, ``text`` of the repaired conversations; inserted rows have an empty text."""
    edits = stored(plans.select("conv", "audit").mapInArrow(_edits, "conv string, at long, pos long, role string"))
    old = rows.select("conv", "pos", F.col("role").alias("own"), "text")
    held = edits.filter("pos IS NOT NULL").join(old, ["conv", "pos"]).select("conv", "at", F.coalesce("role", "own").alias("role"), "text")
    return held.unionByName(edits.filter("pos IS NULL").select("conv", "at", "role", F.lit("").alias("text")))


def repair_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """A report on every conversation, those of ``known`` without a row included, and the rows of all repaired ones.

    Report: the id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and
    ``repaired_sha256``. Rows: ``conv`` (the id as text), ``at``, ``role``, ``text``. Null roles and texts are one space; rows without an id are one
    conversation. Rows of one turn are in order of role and text, so repeated rows are neighbours and the later
    ones duplicates. Turns that are null come first and have no gaps. Texts and conversations of any length are used whole; the
    digest of a conversation is a running one over its sorted lines. An empty table gives none. Other columns are not read.
    """
    found = [F.col(f"`{c}`") for c in (conv, turn, role, text)]
    space = F.lit(" ")
    rows = turns.select(
        conversation_key(found[0]).alias("conv"), found[1].alias("turn"), F.coalesce(found[2], space).alias("role"), F.coalesce(found[3], space).alias("text")
    )
    named = (turns if known is None else known).select(found[0].alias("id"))
    ids = named.groupBy(conversation_key(F.col("id")).alias("conv")).agg(F.max("id").alias("id"))
    rows = stored(with_faults(rows))
    counts = rows.groupBy("conv").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    extent = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = rows.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(extent, F.lit(0)).cast("long").alias("gaps"))
    plans = stored(repair_plans(rows))
    lines = repaired_lines(rows, plans)
    text_line = F.concat("role", F.lit(":"), "text").alias("line")
    sorted_ = lines.repartition("conv").sortWithinPartitions("conv", "at").select("conv", text_line)
    digests = sorted_.mapInArrow(_digests, "conv string, digest string")
    report = ids.join(counts, "conv", "left").join(gaps, "conv", "left").join(plans, "conv", "left").join(digests, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256().hexdigest())
    report = report.select(
        F.col("id").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", none).alias("repaired_sha256")
    )
    return report, lines


def damaged(turns: DataFrame) -> DataFrame:
    """The columns of ``conversations``, of which one row in four is damaged, as the CRC-32 of ``conv_id:turn`` tells."""
    space = F.lit(" ")
    name = F.concat(conversation_key(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    cut = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), "kind")
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("time")
    return changed.select("conv_id", "turn", "role", "text", times).drop("time")
