"""Search results and pages: filters, union by address, page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Addresses that are left out.
BLOCKED = ("zhihu", "baidu", "sohu")


def allowed_results(results: DataFrame, query: str, rank: str, url: str, blocked: tuple[str, ...] = BLOCKED, most: int = 20) -> DataFrame:
    """The first ``most`` results of each query whose address is not blocked and no PDF, re-indexed from 0."""
    ok = ~F.endswith(url, F.lit(".pdf"))
    for b in blocked:
        ok &= ~F.contains(F.col(url), F.lit(b))
    place = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return results.where(ok).withColumn("idx", (place - 1).cast("long")).where(F.col("idx") < most)


def union_by_url(results: DataFrame, url: str, query: str, rank: str, snippet: str) -> DataFrame:
    """url, n, first query, snippets: one row for each address, snippets in (query, rank) order."""
    one = F.struct(F.col(query).alias("q"), F.col(rank).alias("r"), F.col(snippet).alias("s"))
    return results.groupBy(url).agg(F.count("*").alias("n"), F.min(one)["q"].alias("first_query"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "\n").alias("snippets"))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, common entities as characters, line ends as one."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"<[A-Za-z/!][^<>]*>", "")
    for old, new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[\r\n]+", "\n")


def fetched(pages: DataFrame, html: str, least: int = 50, most: int = 1024) -> DataFrame:
    """Pages with more than ``least`` characters of text, cut at ``most``."""
    return pages.withColumn("content", page_text(F.col(html))).where(F.length("content") > least).withColumn("content", F.substring("content", 1, most))
