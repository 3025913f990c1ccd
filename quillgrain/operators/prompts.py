"""Prompt catalogues: Markdown to records, checks and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrain.functions import text as T


def prompt_blocks(markdown: Column, keep_hashes: bool = False) -> Column:
    """array<struct<system_prompt, example: array<struct<input, output>>>> of a Markdown text.

    A block starts at ``### Prompt``; its questions and answers stand under ``#### Q：`` and
    ``#### A：`` or, where no such pair is found, with ASCII colons. Text from a ``#`` to the end
    of its line is dropped unless ``keep_hashes``.
    """

    def clean(c: Column) -> Column:
        out = T.strip(c)
        return out if keep_hashes else F.regexp_replace(out, "#.*", "")

    def pairs(block: Column, colon: str) -> Column:
        found = F.regexp_extract_all(block, F.lit(f"(?s)#### Q{colon}.*?#### A{colon}.*?(?=#### Q{colon}|\\z)"), F.lit(0))
        body = f"(?s)#### Q{colon}(.*?)#### A{colon}(.*)"
        return F.transform(found, lambda x: F.struct(clean(F.regexp_extract(x, body, 1)).alias("input"), clean(F.regexp_extract(x, body, 2)).alias("output")))

    def record(block: Column) -> Column:
        examples = T.let(pairs(block, "："), lambda wide: F.when(F.size(wide) > 0, wide).otherwise(pairs(block, ":")))
        return F.struct(clean(F.regexp_extract(block, "(?s)^(.*?)(?:#### Q：|\\z)", 1)).alias("system_prompt"), examples.alias("example"))

    parts = F.split(markdown, r"(?i)###\s+Prompt\s*[:：]?\s*\n")
    return F.transform(F.slice(parts, 2, 1_000_000), record)


def titled_sections(markdown: Column) -> Column:
    """array<struct<name, body>>: the text cut before each heading of the first heading's level."""
    level = T.first_heading_level(markdown)
    marked = F.regexp_replace(markdown, F.concat(F.lit(r"(?m)^("), level, F.lit(r" [^#\n]+)$")), "\u0001$1")
    sections = F.filter(F.split(marked, "\u0001"), lambda s: T.strip(s) != "")
    one = F.transform(sections, lambda s: F.struct(F.coalesce(F.nullif(F.trim(F.regexp_extract(s, r"^#{1,2}\s*(.*?)\s*(?:\n|\z)", 1)), F.lit("")), F.lit("无标题")).alias("name"), s.alias("body")))
    return F.when(level == "", F.array(F.struct(F.lit("无标题").alias("name"), markdown.alias("body")))).otherwise(one)


def catalogue_records(files: DataFrame, name: str, markdown: str) -> DataFrame:
    """id (from the file name), name, system_prompt, example: one row for each prompt block."""
    section = files.select(T.catalogue_number(F.col(name)).alias("id"), F.explode(titled_sections(F.col(markdown))).alias("s"))
    return section.select("id", F.col("s.name").alias("name"), F.explode(prompt_blocks(F.col("s.body"))).alias("b")).select("id", "name", "b.system_prompt", "b.example")


def template_check(markdown: Column) -> Column:
    """struct<ok, message>: a Chinese heading of level two, a prompt part, and Q and A in every example part."""
    head = markdown.rlike(r"(?m)^##\s+[一-鿿]+")
    prompt = markdown.rlike(r"(?m)^###\s+Prompt")
    parts = F.slice(F.split(markdown, r"(?m)^###\s+效果示例"), 2, 1_000_000)
    bad = F.exists(parts, lambda p: ~(p.rlike(r"####\s+Q[：:]") & p.rlike(r"####\s+A[：:]")))
    made = lambda ok, m: F.struct(F.lit(ok).alias("ok"), F.lit(m).alias("message"))
    return F.when(~head, made(False, "不存在以## 开头的汉字标题")).when(~prompt, made(False, "Prompt部分未识别")).when(bad, made(False, "效果示例部分的 Q：或 A：未识别")).otherwise(made(True, "格式正确"))


def scene_by_label(scenes: DataFrame, label: str) -> DataFrame:
    """The first scene whose type starts with ``label`` and the full-width colon, in type order."""
    return scenes.where(F.startswith("type", F.lit(f"{label}："))).orderBy("type").limit(1)


def is_known_label(types: Column, label: Column) -> Column:
    return F.exists(types, lambda t: F.startswith(t, F.concat(label, F.lit("："))))


def describe(attributes: Column, descriptions: Column) -> Column:
    """attribute -> description, null where none is known."""
    return F.map_from_arrays(attributes, F.transform(attributes, lambda a: F.try_element_at(descriptions, a)))


def empty_slots(attributes: Column) -> Column:
    """attribute -> empty text."""
    return F.map_from_arrays(attributes, F.transform(attributes, lambda a: F.lit("")))


def has_empty(slots: Column) -> Column:
    return F.exists(F.map_values(slots), lambda v: v.isNull() | (v == ""))


def first_entry(records: Column) -> tuple[Column, Column]:
    """Key and value of the first entry of a map."""
    return F.get(F.map_keys(records), F.lit(0)), F.get(F.map_values(records), F.lit(0))


def literal_list(text: Column) -> Column:
    """A model's list as an array; null where it is none."""
    return F.try_variant_get(F.try_parse_json(T.scrub_literal(text)), "$", "array<string>")

