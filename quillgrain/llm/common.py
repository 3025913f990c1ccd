"""Text primitives and flat views of the reply tables, shared by the operators of this subpackage."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrain.session import table

NOT_WORD = re.compile(r"[\W_]+")
_OPENS = re.compile(r"\{\s*[\"}]")


def normalise(text: str | None) -> str:
    """NFKC, lower case, letters and digits only; null gives an empty text."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return NOT_WORD.sub("", text.lower())


def json_object(text: str | None) -> dict | None:
    """The object at the first brace that can open one, if it parses; else None.

    Fences, lead-in lines and trailing text around the object are ignored.
    """
    hit = _OPENS.search(text) if text else None
    if not hit:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text, hit.start())
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def answer_text(text: str | None) -> str:
    """The ``answer`` of a parsable object that has one, else the whole text; null gives an empty text."""
    if text is None:
        return ""
    found = json_object(text) if "{" in text else None
    answer = found.get("answer") if found else None
    return answer if isinstance(answer, str) else text


# Replies that say nothing.
PLACEHOLDERS = frozenset(normalise(x) for x in ("null", "none", "n/a", "na", "nan", "nil", "empty", "undefined", "tbd", "todo", "答", "回答", "答案", "answer", "无", "暂无", "output", "response", "回复", "json"))
_QUESTION = re.compile(r"(?:^|\n)[ \t]*(?:问题|Question)[ \t]*[:：][ \t]*(.*)")
_CHUNK = re.compile(r"\[chunk_id=([^\s\]]+)")


def question_of(prompt: str | None) -> str:
    """The question line of an evidence prompt, else the whole prompt."""
    if not prompt:
        return ""
    hit = _QUESTION.search(prompt)
    return hit[1].strip() if hit else prompt


def chunk_of(prompt: str | None) -> str | None:
    """The chunk that an evidence prompt names."""
    hit = _CHUNK.search(prompt) if prompt else None
    return hit[1] if hit else None


def pair_replies(pairs: DataFrame) -> DataFrame:
    """preference_pairs, one row for each of chosen and rejected."""
    both = F.explode(
        F.array(
            F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("reply")),
            F.struct(F.lit("rejected").alias("field"), F.col("rejected").alias("reply")),
        )
    )
    return pairs.select("pair_id", "source", "prompt", F.col("meta.type").alias("kind"), both.alias("r")).select(
        F.lit("preference_pairs").alias("tbl"), F.col("pair_id").cast("string").alias("row_key"), F.col("r.field").alias("field"), F.lit(1).alias("turn_no"),
        F.col("source").alias("source"), F.col("prompt").alias("prompt"), F.col("r.reply").alias("reply"), F.coalesce(F.col("kind") == "unanswerable", F.lit(False)).alias("may_refuse"),
    )


def call_replies(calls: DataFrame) -> DataFrame:
    """call_log, one row for each delivery; a call delivered twice appears twice."""
    return calls.select(
        F.lit("call_log").alias("tbl"), F.col("log_id").cast("string").alias("row_key"), F.lit("raw_output").alias("field"), F.lit(1).alias("turn_no"),
        F.col("model_type").alias("source"), F.col("question").alias("prompt"), F.col("raw_output").alias("reply"), F.coalesce(F.col("evidence_length") == 0, F.lit(False)).alias("may_refuse"),
    )


def turn_replies(samples: DataFrame) -> DataFrame:
    """sft_conversations, one row for each turn."""
    turns = samples.select("sample_id", "source", "sample_type", F.posexplode("conversation").alias("pos", "t"))
    return turns.select(
        F.lit("sft_conversations").alias("tbl"), F.col("sample_id").alias("row_key"), F.lit("output").alias("field"), (F.col("pos") + 1).cast("int").alias("turn_no"),
        F.col("source").alias("source"), F.col("t.input").alias("prompt"), F.col("t.output").alias("reply"), F.coalesce(F.col("sample_type") == "unanswerable", F.lit(False)).alias("may_refuse"),
    )


def replies(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> DataFrame:
    """The replies of the named tables in one shape: tbl, row_key, field, turn_no, source, prompt, reply, may_refuse."""
    flat = {"preference_pairs": pair_replies, "call_log": call_replies, "sft_conversations": turn_replies}
    parts = [flat[name](table(spark, sf_dir, name)) for name in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def joined_answers(df: DataFrame, key: str, outputs: str) -> DataFrame:
    """key and text: the answer texts of an array of outputs, a line each; a null array gives an empty text."""
    flat = df.select(F.col(key).alias("k"), F.col(outputs).alias("o"))

    def run(batches):
        for b in batches:
            yield b[["k"]].assign(text=["\n".join(map(answer_text, o)) if o is not None else "" for o in b["o"]])

    return flat.mapInPandas(run, flat.select("k").schema.add("text", "string")).withColumnRenamed("k", key)


def compared_texts(records: DataFrame) -> DataFrame:
    """side, tbl, key, scope, norm of records (side, tbl, key, about, chunk, body).

    Where ``about`` holds, the text is the prompt's question and the scope is ``chunk``, or else the
    chunk that the prompt names; a record about no chunk is left out, for it can have no case.
    Elsewhere the whole body counts and the scope is null.
    """
    flat = records.select("side", "tbl", "key", "about", "chunk", "body").where("body is not null")

    def run(batches):
        for b in batches:
            scope = [(c if c is not None else chunk_of(x)) if about else None for about, c, x in zip(b["about"], b["chunk"], b["body"])]
            norm = [normalise(question_of(x) if about else x) for about, x in zip(b["about"], b["body"])]
            out = b[["side", "tbl", "key"]].assign(scope=scope, norm=norm)
            yield out[[s is not None or not about for s, about in zip(scope, b["about"])]]

    return flat.mapInPandas(run, flat.select("side", "tbl", "key").schema.add("scope", "string").add("norm", "string"))
