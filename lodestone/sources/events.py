"""The usage log as JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.plans.answers import EVENT_COLUMNS
from lodestone.sources.paths import path_exists

# Field names and types of a log line.
EVENT_SCHEMA = (
    "ts string, endpoint string, metodo string, modelo string, ok boolean, erro string, duracao_ms double, "
    "prompt_tokens long, completion_tokens long, total_tokens long, top_score double"
)
_FALSE = ("false", "0", "0.0", "", "[]", "{}")
_END = "\x01end"
_TEXTS = ("ts", "endpoint", "metodo", "modelo", "erro")
_COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")
_NUMBERS = ("duracao_ms", "top_score")


def fields_of(line: Column) -> Column:
    """Map of a line's fields, null unless the line is exactly one JSON object.

    Read as the first of two elements of an array, the second of which marks its end: whatever
    follows the object in the line either breaks the parse or hides the mark.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), line, F.lit(',{"\\u0001end":""}]')), "array<map<string,string>>", {"allowSingleQuotes": "false"}
    )
    marked = F.map_contains_key(F.get(wrapped, F.lit(1)), _END)
    return F.when((F.size(wrapped) == 2) & marked, F.get(wrapped, F.lit(0)))


def event_fields(fields: Column) -> list[Column]:
    """Typed columns: a missing ``ok`` is true, an explicit null false; other gaps stay null."""

    def value(name: str) -> Column:
        return F.try_element_at(fields, F.lit(name))

    number = {n: F.replace(value(n), F.lit('"'), F.lit("")).try_cast("double") for n in (*_NUMBERS, *_COUNTS)}
    ok = F.when(~F.map_contains_key(fields, "ok"), F.lit(True)).otherwise(
        F.coalesce(~value("ok").isin(*_FALSE), F.lit(False))
    )
    columns = {n: value(n) for n in _TEXTS}
    columns |= {n: number[n] for n in _NUMBERS}
    columns |= {n: F.coalesce(value(n).try_cast("long"), number[n].cast("long")) for n in _COUNTS}
    columns["ok"] = ok
    return [columns[n].alias(n) for n in EVENT_COLUMNS]


def parse_events(lines: DataFrame, *keep: str) -> DataFrame:
    """Events from a column ``value`` of lines; blank and malformed lines are left out."""
    parsed = lines.select(*keep, fields_of(F.col("value")).alias("_fields")).filter(F.col("_fields").isNotNull())
    return parsed.select(*keep, *event_fields(F.col("_fields")))


LINE_ORDER = ("src_file", "src_block", "src_row")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``src_file, src_block, src_row``, which give the order of its lines."""
    if not path_exists(spark, path):
        places = "src_file string, src_block long, src_row long, "
        return spark.createDataFrame([], places + EVENT_SCHEMA)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
        "value",
    )
    return parse_events(lines, *LINE_ORDER)


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Add log rows to a folder of JSON lines.

    With the name of a ``batch`` the append can be repeated: rows are written aside, moved in under names that
    begin with the batch's, and the batch is noted in ``_commits``. A batch noted there is not written
    again; what an append that was broken off left of one is replaced. One writer at a time for each batch.
    """
    rows = events.select(*EVENT_COLUMNS)
    if batch is None:
        rows.write.mode("append").option("ignoreNullFields", False).json(path)
        return
    if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
        raise ValueError("a batch is named by letters, digits and hyphens")
    spark = events.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder, done, aside = path_of(path), path_of(f"{path}/_commits/{batch}"), path_of(f"{path}/_aside/{batch}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(done):
        return
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(aside.toString())
    for left in files.globStatus(path_of(folder, f"batch_{batch}_*.json")) or []:
        files.delete(left.getPath(), False)
    for i, part in enumerate(files.globStatus(path_of(aside, "part-*")) or []):
        target = path_of(folder, f"batch_{batch}_{i:06d}.json")
        if not files.rename(part.getPath(), target):
            raise OSError(f"{target} cannot be written")
    files.create(done, True).close()
    files.delete(aside, True)
