"""Evidence chunks: lookups by id, citations, answer objects and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T

CITATIONS = "array<struct<doc_id:string,section:string,chunk_id:string,quote:string>>"


def chunk_map(corpus: DataFrame) -> DataFrame:
    """One row for each chunk_id: of rows with the same id the last in file order counts."""
    last = F.max_by(F.struct("doc_id", "section", "title", "text"), "line_no")
    return corpus.where("chunk_id is not null").groupBy("chunk_id").agg(last.alias("c")).select("chunk_id", "c.*")


def lookup_evidence(samples: DataFrame, key: str, ids: str, chunks: DataFrame) -> DataFrame:
    """key, n_ids, found (the chunks in list order), missing (ids without a chunk)."""
    wanted = samples.select(key, F.posexplode(ids).alias("pos", "chunk_id"))
    hit = wanted.join(chunks.withColumn("hit", F.lit(True)), "chunk_id", "left")
    one = F.struct("pos", "chunk_id", "doc_id", "section", "text")
    return hit.groupBy(key).agg(
        F.count("*").alias("n_ids"), F.array_sort(F.collect_list(F.when(F.col("hit"), one))).alias("found"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.struct("pos", "chunk_id")))), lambda x: x["chunk_id"]).alias("missing"),
    )


def evidence_text(found: Column) -> Column:
    """The blocks of looked-up chunks, a blank line between."""
    return F.array_join(F.transform(found, lambda c: T.evidence_block(c["chunk_id"], c["doc_id"], c["section"], c["text"])), "\n\n")


def parsed(reply: Column) -> Column:
    """The reply's object as VARIANT, null where nothing parses; fences and lead-ins are ignored."""
    return F.try_parse_json(T.brace_object(reply))


def field(obj: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(obj, f"$.{name}", kind)


def json_kind(obj: Column, name: str) -> Column:
    """STRING, OBJECT, ARRAY ... of a field; VOID for a JSON null; null where the key is missing."""
    return F.regexp_extract(F.schema_of_variant(F.variant_get(obj, f"$.{name}", "variant")), r"^(\w+)", 1)


def validation_message(obj: Column) -> Column:
    """First broken rule of an answer object, ``ok`` for none; ``not an object`` for a null."""
    keys = ("answer", "citations", "confidence", "cannot_answer_reason")
    items = F.try_variant_get(obj, "$.citations", "array<variant>")
    kind = {k: json_kind(obj, k) for k in keys}
    parts = ("doc_id", "section", "chunk_id", "quote")

    def lacks_text(part: str):
        return lambda c: F.coalesce(F.schema_of_variant(F.variant_get(c, f"$.{part}", "variant")) != "STRING", F.lit(True))

    is_object = lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT"))
    rules = [(obj.isNull() | ~is_object(obj), "not an object")]
    rules += [(F.variant_get(obj, f"$.{k}", "variant").isNull(), f"missing {k}") for k in keys]
    rules += [(kind["answer"] != "STRING", "answer is not text"), (kind["citations"] != "ARRAY", "citations is not a list")]
    rules += [(F.exists(items, lambda c: ~is_object(c)), "citation is not an object")]
    for p in parts:
        rules += [(F.exists(items, lacks_text(p)), f"citation without text {p}")]
    rules += [(~F.coalesce(field(obj, "confidence").isin("low", "mid", "high"), F.lit(False)) | (kind["confidence"] != "STRING"), "confidence is not low, mid or high")]
    rules += [(~kind["cannot_answer_reason"].isin("STRING", "VOID"), "cannot_answer_reason is not text or null")]
    rules += [((kind["cannot_answer_reason"] == "VOID") & (F.size(items) == 0), "answerable without citations")]
    out = F.lit("ok")
    for broken, message in reversed(rules):
        out = F.when(broken, F.lit(message)).otherwise(out)
    return out


def cited(rows: DataFrame, keys: list[str], citations: str, chunks: DataFrame) -> DataFrame:
    """keys, pos, chunk_id, quote, exact: each citation and whether its chunk holds the quote word for word."""
    each = rows.select(*keys, F.posexplode(citations).alias("pos", "c")).select(*keys, "pos", F.col("c.chunk_id").alias("chunk_id"), F.col("c.quote").alias("quote"))
    held = each.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    return held.withColumn("exact", F.coalesce(F.contains("chunk_text", "quote") & (F.col("quote") != ""), F.lit(False))).drop("chunk_text")


def candidate_score(unanswerable: Column, reply: Column, obj: Column, valid: Column, reason: Column, n_citations: Column, flags: Column, covered: Column) -> Column:
    """Points of a candidate answer. ``flags`` says for each citation in order whether its quote is exact."""
    refused = reason.isNotNull() & (T.strip(reason) != "")
    bad = F.exists(flags, lambda x: ~x)
    no = F.when(refused, 2).otherwise(-3) + F.when(n_citations == 0, 1).otherwise(-2) + F.when(bad, -5).otherwise(0)
    quotes = F.aggregate(F.slice(flags, 1, 3), F.lit(0), lambda s, x: s + F.when(x, 3).otherwise(-5))
    yes = F.when(reason.isNull(), 0).otherwise(-4) + F.when(n_citations > 0, 1).otherwise(-4) + quotes + F.when(covered >= 0.3, 2).when(covered >= 0.15, 1).otherwise(-2)
    body = F.lit(2) + F.when(valid, 2).otherwise(-2) + F.when(unanswerable, no).otherwise(yes)
    return F.when(reply.isNull() | (T.strip(reply) == ""), -10).when(obj.isNull(), -8).otherwise(body).cast("long")


def answers(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both answers of every pair with all that is judged: valid, citations, exact quotes, coverage, score.

    Columns: pair_id, field, kind, parsed_ok, valid, n_citations, n_exact, first_exact, covered, refused, score.
    """
    both = F.explode(F.array(F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("reply")), F.struct(F.lit("rejected").alias("field"), F.col("rejected").alias("reply"))))
    rows = pairs.select("pair_id", F.col("meta.type").alias("kind"), F.col("meta.evidence_chunk_ids").alias("ids"), both.alias("r")).select("pair_id", "kind", "ids", "r.*").withColumn("obj", parsed(F.col("reply")))
    rows = rows.withColumn("message", validation_message(F.col("obj"))).withColumn("cits", F.coalesce(field(F.col("obj"), "citations", CITATIONS), F.array().cast(CITATIONS))).withColumn("reason", field(F.col("obj"), "cannot_answer_reason")).withColumn("answer", field(F.col("obj"), "answer"))
    keys = ["pair_id", "field"]
    flags = cited(rows, keys, "cits", chunks).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "exact"))), lambda x: x["exact"]).alias("flags"))
    texts = lookup_evidence(pairs.select("pair_id", F.col("meta.evidence_chunk_ids").alias("ids")), "pair_id", "ids", chunks).select("pair_id", evidence_text(F.col("found")).alias("evidence"))
    # the evidence of a pair joins both its answers; coverage is then computed row by row
    full = rows.join(flags, keys, "left").join(texts, "pair_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<boolean>")))
    full = full.withColumn("covered", T.coverage(F.coalesce("answer", F.lit("")), F.coalesce("evidence", F.lit(""))))
    unanswerable = F.coalesce(F.col("kind") == "unanswerable", F.lit(False))
    valid = F.col("message") == "ok"
    return full.select(
        *keys, "kind", F.col("obj").isNotNull().alias("parsed_ok"), valid.alias("valid"), "message", F.size("cits").cast("long").alias("n_citations"), F.size(F.filter("flags", lambda x: x)).cast("long").alias("n_exact"),
        F.coalesce(F.get("flags", F.lit(0)), F.lit(False)).alias("first_exact"), F.round("covered", 6).alias("covered"), (F.coalesce(T.strip(F.col("reason")) != "", F.lit(False)) & (F.size("cits") == 0)).alias("refused"),
        candidate_score(unanswerable, F.col("reply"), F.col("obj"), valid, F.col("reason"), F.size("cits"), F.col("flags"), F.col("covered")).alias("score"),
    )


def last_message(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    return turns.groupBy(key).agg(F.max_by(text, order).alias(text))


def order_within(key: str, order: str, name: str = "place") -> Column:
    """0-based place within a key."""
    return (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long").alias(name)
