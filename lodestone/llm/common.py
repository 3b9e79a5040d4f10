"""What the operators of this folder share: text columns from tasks, stored steps, numbering."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from lodestone.session import remove, written

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Rows that one task numbers at a time; a table has as many buckets as that takes.
BUCKET_ROWS = 200_000
# Documents of one part of a step, at least.
PART_DOCS = 5_000


# The folders of the steps written inside the innermost ``steps``, which deletes them.
_own: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write a table once to the shared checkpoint folder and go on from its files.

    ``checkpoint()`` would work out the last stage twice. Neither lineage nor the executors
    that wrote the files are needed afterwards. With ``parts`` it is written by so many tasks at most.
    """
    held, path = written(df if parts is None else df.coalesce(parts))
    if (own := _own.get()) is not None:
        own.append(path)
    return held


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Steps stored inside belong to this block and are deleted at its end; those of others are left alone.

    Whatever is to be read later has to be written by then.
    """
    own: list[str] = []
    token = _own.set(own)
    try:
        yield
    finally:
        _own.reset(token)
        for path in own:
            remove(spark, path)


def parts_for(docs: DataFrame) -> int:
    """In how many parts at most the steps of a stored table of documents are written.

    A session can have many more shuffle partitions than a small table has use for; a file for each costs more than its rows.
    """
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // PART_DOCS))


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text, as two longs; null and empty differ from each other."""
    return F.struct(
        F.xxhash64(F.lit(1), F.col(text), F.octet_length(F.col(text))).alias("a"),
        F.xxhash64(F.col(text), F.lit(2), F.octet_length(F.col(text))).alias("b"),
    )


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where a column of the table has the name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, own: Sequence[str] = (), keep: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with other names for columns that an operator's own might meet, and the way back for its result.

    Those are the names in ``own`` and all that begin with an underscore, except for ``keep``, the columns an
    operator is told to use.
    """
    met = [c for c in df.columns if c not in keep and (c.startswith("_") or c.lower() in {o.lower() for o in own})]
    names = dict(zip(met, spare(df, *[f"kept{i}" for i in range(len(met))])))

    def back(done: DataFrame) -> DataFrame:
        old = {new: c for c, new in names.items()}
        return done.select(*[F.col(f"`{c}`").alias(old.get(c, c)) for c in done.columns]) if old else done

    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]) if met else df, back


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that an operator is about to add under the same names."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def _columns_from_text(
    batches: Iterator[pa.RecordBatch], make: Callable[[pa.Array], dict], text: str, passed: Sequence[str], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        new = make(texts)
        old = {c: batch.column(batch.schema.get_field_index(c)) for c in passed}
        yield pa.RecordBatch.from_arrays([old.get(f.name, new.get(f.name)).cast(f.type) for f in schema], schema=schema)


def with_text_columns(
    docs: DataFrame, make: Callable[[pa.Array], dict], fields: Sequence[pa.Field], text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Columns that a function works out from the texts of each Arrow batch, beside the others.

    ``make`` takes the array of texts and returns arrays by name. Columns of the same name
    as a new one are replaced. The text itself is passed on only if asked for.
    """
    spark = docs.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)  # so that workers find this package
    names = [f.name for f in fields]
    passed = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*passed, text])])
    added = from_arrow_schema(pa.schema(fields))
    out = T.StructType([*[source.schema[c] for c in passed], *added])
    from pyspark.sql.pandas.types import to_arrow_schema

    run = partial(_columns_from_text, make=make, text=text, passed=passed, schema=to_arrow_schema(out))
    return source.mapInArrow(run, out)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps; a stored ``df`` is read twice.

    Rows are dealt to buckets by a hash, so a group of any size is cut over many tasks: each
    bucket numbers its rows, and the counts of the buckets before are added.
    """
    total = df.count() if rows is None else rows
    buckets = max(8, -(-total // BUCKET_ROWS))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_bucket", "_start", "_at")
    )


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole table, with the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
