"""Documents as lines: cleaning, repeated lines and sections carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line: one normalised row for each line; null texts give none.

    Lines are normalised before the explode: as an expression after it, every later predicate would
    compute it again.
    """
    lines = F.transform(F.split(F.col(text), "\n"), T.normalize_line)
    return docs.select(key, F.posexplode(lines).alias("line_no", "line")).select(key, F.col("line_no").cast("long").alias("line_no"), "line")


def repeated_lines(lines: DataFrame, key: str = "doc_id", most_len: int = 80, min_count: int = 20) -> DataFrame:
    """key, line, n: short lines that recur within a document, page numbers aside."""
    short = lines.where(F.length("line").between(1, most_len) & ~T.is_page_number(F.col("line")))
    return short.groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def clean_lines(lines: DataFrame, key: str = "doc_id", most_len: int = 80, min_count: int = 20) -> DataFrame:
    """Lines that are not empty, repeated, page numbers, table noise or like a table of contents.

    The repeated lines are few for each document but many in all, so the join strategy is left to
    the optimiser.
    """
    line = F.col("line")
    kept = lines.where(~(T.is_page_number(line) | T.is_table_noise(line) | T.is_toc_like(line)))
    return kept.join(repeated_lines(lines, key, most_len, min_count).select(key, "line"), [key, "line"], "left_anti")


def carry_sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, section, title, line: each text line under the last heading before it.

    Headings give no row; a heading without title resets the title to null, hence the struct.
    """
    section, title = T.heading(F.col("line"))
    marked = lines.withColumn("h", F.when(section.isNotNull(), F.struct(section.alias("section"), title.alias("title"))))
    over = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("last", F.last("h", ignorenulls=True).over(over)).where(F.col("h").isNull())
    return carried.select(key, "line_no", F.col("last.section").alias("section"), F.col("last.title").alias("title"), "line")


def group_sections(units: DataFrame, key: Column, section: Column, title: Column, order: Column, text: Column) -> DataFrame:
    """Ordered texts of each (key, section), first-seen order and the first title, null or not."""
    one = units.select(key.alias("doc_id"), T.section_or_unknown(section).alias("section"), title.alias("title"), order.alias("line_no"), text.alias("text")).where("doc_id is not null and text is not null").where(T.strip(F.col("text")) != "")
    return one.groupBy("doc_id", "section").agg(
        F.min("line_no").alias("first_line"), F.min_by(F.struct("title"), "line_no")["title"].alias("title"), F.count("*").alias("n_parts"), F.sum(F.length("text")).alias("n_chars"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"),
    )
