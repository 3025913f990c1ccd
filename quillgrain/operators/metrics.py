"""Aggregate reports over judged answers and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrain.functions import text as T

RATES = ("parse_rate", "schema_rate", "citation_rate", "grounded_rate", "refusal_rate")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


def preferences(judged: DataFrame, margin: int) -> DataFrame:
    """pair_id, better, score_chosen, score_rejected, margin of pairs at or over the margin.

    Both answers of a pair come from one row, so one aggregation replaces a self-join.
    """
    both = judged.groupBy("pair_id").agg(F.max(F.when(F.col("field") == "chosen", F.col("score"))).alias("sa"), F.max(F.when(F.col("field") == "rejected", F.col("score"))).alias("sb"))
    gap = F.abs(F.col("sa") - F.col("sb"))
    return both.where(gap >= margin).select("pair_id", F.when(F.col("sa") > F.col("sb"), "chosen").otherwise("rejected").alias("better"), F.greatest("sa", "sb").alias("score_chosen"), F.least("sa", "sb").alias("score_rejected"), gap.alias("margin"))


def pair_report(pairs: DataFrame, margin: int) -> DataFrame:
    """tried, kept, keep_rate, mean_margin of the kept."""
    kept = F.col("margin") >= margin
    return pairs.agg(F.count("*").alias("tried"), F.count_if(kept).alias("kept"), _share(F.count_if(kept), F.greatest(F.lit(1), F.count("*"))).alias("keep_rate"), F.round(F.avg(F.when(kept, F.col("margin"))), 6).alias("mean_margin"))


def metrics(judged: DataFrame, by: str) -> DataFrame:
    """One row for each model: rates over all answers, micro citation rate, refusals among parsed unanswerable ones."""
    no = F.coalesce(F.col("kind") == "unanswerable", F.lit(False)) & F.col("parsed_ok")
    total = F.greatest(F.lit(1), F.count("*"))
    return judged.groupBy(F.col(by).alias("model")).agg(
        F.count("*").alias("n"), _share(F.count_if("parsed_ok"), total).alias("parse_rate"), _share(F.count_if("valid"), total).alias("schema_rate"), _share(F.sum("n_exact"), F.sum("n_citations")).alias("citation_rate"),
        _share(F.count_if(F.col("covered") >= 0.2), total).alias("grounded_rate"), _share(F.count_if(no & F.col("refused")), F.count_if(no)).alias("refusal_rate"),
    )


def quality_report(judged: DataFrame) -> DataFrame:
    """Rates of a built set with the acceptance gates."""
    total = F.greatest(F.lit(1), F.count("*"))
    r = judged.agg(
        F.count("*").alias("total"), F.count_if("refused").alias("refusals"), _share(F.count_if("parsed_ok"), total).alias("parse_rate"), _share(F.count_if("valid"), total).alias("schema_rate"),
        _share(F.count_if(F.col("first_exact") & ~F.col("refused")), F.greatest(F.lit(1), F.count("*") - F.count_if("refused"))).alias("quote_rate"), _share(F.count_if("refused"), total).alias("refusal_ratio"),
    )
    return r.withColumns({"parse_ok": F.col("parse_rate") >= 0.99, "quote_ok": F.col("quote_rate") >= 0.95, "refusal_ok": F.col("refusal_ratio").between(0.15, 0.3)})


def compare(table: DataFrame, base: str, now: str, threshold: float = 0.01) -> DataFrame:
    """metric, base, now, trend, improved: two models' metrics side by side."""
    tall = table.select("model", *RATES).unpivot(["model"], list(RATES), "metric", "value")
    wide = tall.groupBy("metric").agg(F.max(F.when(F.col("model") == base, F.col("value"))).alias("base"), F.max(F.when(F.col("model") == now, F.col("value"))).alias("now"))
    return wide.select("metric", "base", "now", T.trend(F.col("base"), F.col("now")).alias("trend"), (F.col("now") - F.col("base") >= threshold).alias("improved"))


def report_markdown(compared: DataFrame) -> str:
    """The comparison as a Markdown table; a handful of rows comes to the driver."""
    shown = compared.select("metric", T.metric_text(F.col("base")).alias("b"), T.metric_text(F.col("now")).alias("n"), "trend").orderBy("metric").collect()
    return "\n".join(["| metric | base | now | trend |", "| --- | --- | --- | --- |", *(f"| {r['metric']} | {r['b']} | {r['n']} | {r['trend']} |" for r in shown)])


def failures(judged: DataFrame, by: str) -> DataFrame:
    """Counts of failure classes; the first that applies names an answer."""
    refused, no = F.col("refused"), F.coalesce(F.col("kind") == "unanswerable", F.lit(False))
    name = F.when(~F.col("parsed_ok"), "invalid json").when(refused & F.coalesce(F.col("kind") == "answerable", F.lit(False)), "false refusal").when(F.col("n_exact") < F.col("n_citations"), "bad citation").when(no & ~refused, "fabricated").otherwise("fine")
    return judged.groupBy(by, name.alias("failure")).agg(F.count("*").alias("n"))


def corpus_stats(chunks: DataFrame, tiny: int = 120, most: int = 2200) -> DataFrame:
    """One row of counts and lengths over the chunks that have a text."""
    n = F.length("text")
    return chunks.where("text is not null").agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(n), 6).alias("mean_len"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.count_if(n < tiny).alias("n_tiny"), F.count_if(n > most).alias("n_over"), F.countDistinct("section").alias("n_sections"),
    )
