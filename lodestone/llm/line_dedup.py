"""Removal of lines that repeat earlier ones, by windows of three lines.

A window is three consecutive lines. Where a window occurs more than once in the whole table,
its first occurrence stays, and the lines of all later ones go; windows overlap, so longer
repeats are covered by merging positions. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.common import spare, without
from lodestone.operators.rows import fields_per_row

WINDOW = 3


def _hashes(lines: list[Column]) -> list[Column]:
    """Two independent hashes of a window; together they stand for it."""
    return [F.xxhash64(*lines), F.xxhash64(F.lit(WINDOW), *reversed(lines))]


def _windows() -> Column:
    """Windows of the column ``_lines``: position of the first line, and hashes.

    A text of fewer lines is one window, unless it is blank; windows of blank lines alone do not count.
    """

    def window(i: Column) -> Column:
        lines = [F.get("_lines", i + j) for j in range(WINDOW)]
        a, b = _hashes(lines)
        blank = F.trim(F.concat_ws("", *lines)) == ""
        return F.when(~blank, F.struct(i.alias("at"), a.alias("a"), b.alias("b")))

    last = F.greatest(F.size("_lines") - WINDOW, F.lit(0))
    return F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda w: w.isNotNull())


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``text`` without the lines of repeated windows, ``n_lines`` and ``n_removed``.

    Occurrences are in order of id, then of the text's hash, then of position; a row without
    id comes first. Rows that agree in id and text are one document and get the same
    result. A null text stays null and has no lines, an empty one has one, which
    stays. Lines end at line feeds. Columns of the names added are replaced, others kept. A
    window of any number of occurrences is aggregated before it is shuffled; a document's
    list of positions is no longer than the document.
    """
    base = without(docs, ["n_lines", "n_removed"])
    key, no_id, plain, gone, at, kept = spare(base, "_key", "_no_id", "_plain", "_gone", "_at", "_kept")
    lines = F.split(F.col(text), "\n", -1)
    spread = fields_per_row(
        base.filter(F.col(text) != "").select(F.col(id).alias("_id"), F.xxhash64(text).alias("_key"), lines.alias("_lines")).select("_id", "_key", _windows().alias("_w")),
        ["_id", "_key"],
        F.col("_w"),
        "at",
    )
    place = F.struct("_id", "_key", "at")
    seen = spread.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    repeated = seen.filter("NOT (_first <=> _last)").select("a", "b", "_first")
    later = spread.join(repeated, ["a", "b"]).filter(~place.eqNullSafe(F.col("_first")))
    covered = later.groupBy("_id", "_key").agg(F.collect_set("at").alias("_starts"))
    # a null id joins nothing by itself, so it gets a key of its own
    removed = covered.select(
        F.coalesce("_id", F.lit(0)).alias(plain),
        F.col("_id").isNull().alias(no_id),
        F.col("_key").alias(key),
        F.flatten(F.transform("_starts", lambda i: F.sequence(i, i + WINDOW - 1))).alias(gone),
    )
    keyed = base.select(
        *[f"`{c}`" for c in base.columns],
        F.coalesce(F.col(id), F.lit(0)).alias(plain),
        F.col(id).isNull().alias(no_id),
        F.xxhash64(text).alias(key),
    )
    joined = keyed.join(removed, [plain, no_id, key], "left")
    # positions that stay, by a hash set of those that go. The lines are named twice, so that Spark splits them
    # before they are looked up instead of for each one
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    whole = joined.withColumns({"n_lines": count, at: F.when(F.col(gone).isNotNull(), stays), kept: F.when(F.col(gone).isNotNull(), lines)})
    left = F.when(F.size(kept) > 0, F.transform(at, lambda i: F.get(F.col(kept), i)))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    less = F.when(F.col(gone).isNull(), 0).otherwise(F.col("n_lines") - F.size(at))
    return whole.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in base.columns], "n_lines", less.alias("n_removed"))
