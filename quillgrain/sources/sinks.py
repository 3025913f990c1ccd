"""Sinks: JSON lines and arrays, partitioned and text outputs, side outputs, index tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a single JSON document may hold; larger tables are written as JSON lines.
DOCUMENT_ROWS = 100_000


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, nulls kept, text outside ASCII as it is."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines that a former run has written: where a resumed one goes on."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def json_document(df: DataFrame) -> str:
    """A small table as one indented JSON array; more than DOCUMENT_ROWS rows are refused."""
    rows = df.limit(DOCUMENT_ROWS + 1).toJSON().collect()
    if len(rows) > DOCUMENT_ROWS:
        raise ValueError("too many rows for one JSON document; write JSON lines")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=4)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value, co-located first so that each has few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def entry_text(records: Column) -> Column:
    """``key: value`` blocks of a map, a blank line after each."""
    return F.array_join(F.transform(F.map_entries(records), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n\n"))), "")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def split_outputs(flagged: DataFrame, kept: str, path: str) -> None:
    """Kept and rejected rows into two folders in one pass; the input stays where it is."""
    flagged.withColumn("part", F.when(F.col(kept), "kept").otherwise("rejected")).drop(kept).write.mode("overwrite").partitionBy("part").parquet(path)


def failed(df: DataFrame, key: str, error: str) -> DataFrame:
    """The error log of rows that carry an error."""
    return df.where(F.col(error).isNotNull()).select(key, F.col(error).alias("error"))


def save_index(vectors: DataFrame, path: str, mode: str = "ignore", by: str | None = None) -> DataFrame:
    """An embedding table on disk: ``ignore`` loads what is there, ``overwrite`` rebuilds it, ``errorifexists`` refuses."""
    writer = vectors.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return vectors.sparkSession.read.parquet(path)
