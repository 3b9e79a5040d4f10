"""Reports as JSON: write the sections of a run, read them back as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def section_lines(sections: Mapping[str, DataFrame]) -> DataFrame:
    """``section, line``: every row of every section as one JSON text."""
    parts = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("line"))
        for name, df in sections.items()
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per section (rows are never gathered into one document)."""
    section_lines(sections).write.mode("errorifexists").partitionBy("section").text(path)


def read_section(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/section={section}")


def read_document(spark: SparkSession, path: str, field: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Rows of one list inside nested JSON documents: ``schema`` describes its items.

    One document per file, or with ``multi_line=False`` one per line, which Spark can split.
    """
    nested = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", multi_line).json(path)
    return nested.select(F.inline(field))
