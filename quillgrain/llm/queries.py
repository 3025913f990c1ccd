"""The pN_ queries over whole tables, with the parameters of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrain.functions.text import BLANK
from quillgrain.session import table, write_shared

from . import common, defects, leaks, near_duplicates, overlap, packing, repetition, splitting, toxicity, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective replies of all three tables with their defect."""
    rows = common.replies(spark, sf_dir, ("preference_pairs", "call_log", "sft_conversations"))
    return defects.broken_replies(rows, ["tbl", "row_key", "field", "turn_no"], "prompt", "reply", "may_refuse", ("tbl", "field", "source")).distinct()


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and endings of the values, written once: the histograms and the flags both read them."""
    rows = common.replies(spark, sf_dir, ("preference_pairs", "call_log")).where("field <> 'rejected'")
    return write_shared(truncation.measure(rows, ["tbl", "row_key", "field", "source"], "reply", "prompt"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the pairs' chosen answers and the call log that a limit or a transfer cut."""
    rows = _measured(spark, sf_dir)
    return truncation.cut_values(rows, ["tbl", "field", "source"], ["tbl", "row_key", "field"]).select("tbl", "row_key", "field").distinct()


def p2_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut values with what shows the cut: a limit's length, the end itself, or both."""
    rows = _measured(spark, sf_dir)
    return truncation.cut_values(rows, ["tbl", "field", "source"], ["tbl", "row_key", "field"]).select("tbl", "row_key", "field", "source", "limit_unit", "transfer", "log_odds").distinct()


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits that show in each source's lengths."""
    return truncation.length_limits(_measured(spark, sf_dir), ["tbl", "field", "source"])


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and cut values for each source (pairs) and model type (calls); a call counts once."""
    rows = _measured(spark, sf_dir)
    cut = truncation.cut_values(rows, ["tbl", "field", "source"], ["tbl", "row_key", "field"])
    count = lambda df, name: df.groupBy("tbl", "field", "source").agg(F.countDistinct("row_key").alias(name))
    a, b = count(rows, "n_values"), count(cut, "n_cut")
    joined = a.alias("a").join(b.alias("b"), (F.col("a.tbl") == F.col("b.tbl")) & (F.col("a.field") == F.col("b.field")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    n_cut = F.coalesce(F.col("b.n_cut"), F.lit(0))
    return joined.select("a.tbl", "a.field", "a.source", "a.n_values", n_cut.alias("n_cut"), F.round(n_cut / F.col("a.n_values"), 6).alias("rate"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies at least 30 % of whose 10-character windows occurred earlier in the same answer."""
    rows = common.replies(spark, sf_dir, ("call_log", "sft_conversations"))
    return repetition.repetitive_texts(rows, ["tbl", "row_key", "turn_no"], "reply").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured shares of every reply; a call delivered twice is measured twice."""
    rows = common.replies(spark, sf_dir, ("call_log", "sft_conversations"))
    return repetition.repetition_shares(rows, ["tbl", "row_key", "turn_no"], "reply")


def _sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id and the joined answers of the samples without a repetitive turn."""
    samples = table(spark, sf_dir, "sft_conversations")
    looping = repetition.repetitive_texts(common.turn_replies(samples), ["row_key"], "reply").distinct()
    outputs = samples.select("sample_id", F.col("conversation.output").alias("outputs")).join(looping.withColumnRenamed("row_key", "sample_id"), "sample_id", "left_anti")
    return common.joined_answers(outputs, "sample_id", "outputs")


def _p4(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame, DataFrame]]:
    prompts = table(spark, sf_dir, "all_aigame_prompt").select("entry_key", "system_prompt")
    return [
        ("sft_conversations", "sample_id", *near_duplicates.near_duplicates(_sample_texts(spark, sf_dir), "sample_id", "text")),
        ("all_aigame_prompt", "entry_key", *near_duplicates.near_duplicates(prompts, "entry_key", "system_prompt")),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table that share at least 0.7 of their 4-character substrings."""
    parts = [near_duplicates.expand_pairs(members, links, key).select(F.lit(tbl).alias("tbl"), "key_a", "key_b") for tbl, key, members, links in _p4(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that takes part: its class of equal texts, and that class's links."""
    parts = []
    for tbl, key, members, links in _p4(spark, sf_dir):
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
        parts.append(members.join(ends, "id", "left").select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_key"), F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return parts[0].unionByName(parts[1])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that takes part: its class of equal texts and its group of linked classes."""
    parts = [near_duplicates.groups(members, links, key).select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_key"), F.col("id").alias("class_id"), "group_id") for tbl, key, members, links in _p4(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2200 characters of every oversized chunk."""
    return splitting.split_oversized(table(spark, sf_dir, "evidence_corpus"), "line_no", "text", "section")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks with the kind of boundary that their pieces have."""
    return p5_pieces(spark, sf_dir).where("piece_no = 1").select("line_no", "boundary")


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation questions and inputs (side 0) and training inputs (side 1) with the chunk they are about."""
    samples = table(spark, sf_dir, "sft_conversations").select("sample_id", "split", "sample_type", F.col("conversation")[0]["input"].alias("body"))
    side = F.when(F.col("split") == "train", 1).when(F.col("split").isin("eval", "test"), 0)
    first = samples.select(F.lit("sft_conversations").alias("tbl"), F.col("sample_id").alias("key"), side.cast("int").alias("side"), F.coalesce(F.col("sample_type").isin("answerable", "unanswerable"), F.lit(False)).alias("about"), F.lit(None).cast("string").alias("chunk"), "body")
    asked = table(spark, sf_dir, "eval_set").select(F.lit("eval_set").alias("tbl"), F.col("id").alias("key"), F.lit(0).alias("side"), F.lit(True).alias("about"), F.explode("evidence_chunk_ids").alias("chunk"), F.col("question").alias("body"))
    return common.compared_texts(first.unionByName(asked).where("side is not null"))


def p6_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return overlap.cross_split_links(_split_records(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records that occur again, the same or nearly so, among the training inputs."""
    return overlap.expand_links(*p6_links(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact form: every record of either side with its class of equal texts and its number of links."""
    return overlap.link_counts(*p6_links(spark, sf_dir)).select("side", "tbl", F.col("key").alias("row_key"), "class_id", "n_links")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records with an overlap for each split and source; eval_set is a split of its own."""
    samples = table(spark, sf_dir, "sft_conversations").select(F.lit("sft_conversations").alias("tbl"), F.col("sample_id").alias("eval_key"), "split", "source").where("split in ('eval', 'test')")
    asked = table(spark, sf_dir, "eval_set").select(F.lit("eval_set").alias("tbl"), F.col("id").alias("eval_key"), F.lit("eval_set").alias("split"), F.col("type").alias("source"))
    linked = p6_classes(spark, sf_dir).where("side = 0 and n_links > 0")
    hits = linked.groupBy("tbl", F.col("row_key").alias("eval_key")).agg(F.sum("n_links").alias("n"))  # its classes are about different chunks, which no training row shares
    return samples.unionByName(asked).join(hits, ["tbl", "eval_key"], "left").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, in tokens, assigned to containers of 2048 tokens."""
    sized = packing.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return packing.pack(sized, "doc_id", "n_tokens", 2048)


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest verbatim match of every document with every benchmark item, and where it lies."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which they hold at least 40 consecutive characters."""
    return p8_matches(spark, sf_dir).select("doc_id", "item_id")


def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and source of the documents that hold no benchmark item."""
    docs = table(spark, sf_dir, "documents")
    return leaks.without_leaks(docs.select("doc_id", F.col("source")), "doc_id", p8_found(spark, sf_dir))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and category probabilities."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", ("source",))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abusive, hateful or sexually explicit documents."""
    return p9_scores(spark, sf_dir).where("abusive").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the share of abusive ones for each source; a null source is a source."""
    scored = p9_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg("score").alias("mean_score"))
    return scored.withColumn("rate", F.round(F.col("n_abusive") / F.col("n_docs"), 6)).withColumn("mean_score", F.round("mean_score", 6))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_cuts, p2_limits, p2_rates, p3_found, p3_shares, p4_found, p4_classes, p4_groups, p5_found, p5_pieces, p6_found, p6_classes, p6_counts, p7_containers, p8_found, p8_matches, p8_clean_documents, p9_found, p9_scores, p9_rates)}
ORACLES: dict[str, str] = {
    "p5_found": rf"""with t as (select line_no, regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g') as body from evidence_corpus where text is not null)
select line_no, case when list_max(list_transform(string_split_regex(body, '[\s.!?;:,。！？；：，、]|{BLANK}'), lambda x: length(x))) > 2200 then 'forced' else 'natural' end as boundary from t where length(body) > 2200""",
}
