"""Queries that assemble whole sets, and that write and read again through the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import builders as D
from quillgrain.session import shared_dir, table
from quillgrain.sources import files, sinks

from .building import CAND, KEY, LINESQL, NUM, QUOTE, STRIP
from .registry import query


def composed_sql(scope: str, low: int, high: int) -> str:
    """SQL of ``builders.composed_quote`` over t (the stripped text), s (its lines) and line_no."""
    k = lambda part: KEY(f"{scope}-{part}", "line_no")
    fits = lambda c: f"list_filter({c}, lambda x: length(x) between {low} and {high})"
    one, two, three = fits("s"), fits("[s[i] || chr(10) || s[i + 1] for i in range(1, len(s))]"), fits("[s[i] || chr(10) || s[i + 1] || chr(10) || s[i + 2] for i in range(1, len(s) - 1)]")
    size = f"({low} + {NUM(k('size'), f'(least({high}, length(t)) - {low} + 1)')})"
    window = STRIP(f"substr(t, {NUM(k('at'), f'(length(t) - {size} + 1)')} + 1, {size})")
    picks = " ".join(f"when len({c}) > 0 then ({c})[{NUM(k('line'), f'len({c})')} + 1]" for c in (one, two, three))
    return f"(case when length(t) < {low} then null {picks} when length({window}) >= {low} then {window} end)"


BASE = f"base as (select *, {STRIP('text')} as t, {LINESQL} as s from evidence_corpus where text is not null)"


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "evidence_corpus").where("text is not null")


@query(f"with {BASE} select line_no, {composed_sql('short', 40, 180)} as short, {composed_sql('long', 180, 650)} as long from base")
def q_composed_quote(spark, sf_dir):
    """The exact quote in its order: a line, two lines, three lines, a window."""
    quote = lambda scope, low, high: D.composed_quote(F.col("text"), scope, F.col("line_no"), low, high).alias(scope)
    return _chunks(spark, sf_dir).select("line_no", quote("short", 40, 180), quote("long", 180, 650))


@query(f"""with {CAND}, {QUOTE}, r as (select chunk_id, quote, row_number() over (order by {KEY('evalset', 'line_no')}, line_no) as rank from quoted where quote is not null), e as (select a.rank, a.chunk_id, a.quote, b.chunk_id as next_chunk from r a left join r b on b.rank = a.rank + 1 where a.rank <= 240)
select 'E' || lpad(rank::varchar, 4, '0') as id, case when rank <= 161 then 'answerable' else 'unanswerable' end as type, chunk_id as question_chunk, case when rank <= 161 then chunk_id else next_chunk end as evidence_chunk, quote from e where rank <= 161 or chunk_id <> next_chunk""")
def q_evaluation_set(spark, sf_dir):
    return D.evaluation_set(D.require_rows(_chunks(spark, sf_dir), 20))


def _first(table_sql: str, scope: str, n: int, ids: str) -> str:
    return f"(select * from ({table_sql}) order by {KEY(scope, *ids.split(', '))}, {ids} limit {n})"


_SET = D.instruction_targets(600, 60)
_CHUNK_TITLE = "case when coalesce(title, '') <> '' then title else 'this concept' end"
_REGULAR = f"""select 'regular' as tier, 'definition' as kind, line_no, replace('{D.DEFINITION_QUESTION}', '{{title}}', {_CHUNK_TITLE}) as question, chunk_id as evidence_chunk, q_def as quote, q_def as answer from q where q_def is not null and regexp_matches(text, '(?i)\\b(is|refers to|defined as)\\b')
union all select 'regular', 'condition', line_no, '{D.CONDITION_QUESTION}', chunk_id, q_con, q_con from q where q_con is not null and regexp_matches(text, '(?i)\\bshall\\b|\\bwhen\\b|\\bif\\b')
union all select 'regular', 'procedure', line_no, '{D.PROCEDURE_QUESTION}', chunk_id, q_pro, array_to_string(list_transform(list_filter(list_transform(string_split(q_pro, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '')[1:10], lambda x: '- ' || x), chr(10)) from q where q_pro is not null"""


@query(f"""with {BASE}, q as (select *, {composed_sql('anchor', 80, 220)} as q_anc, {composed_sql('definition', 60, 240)} as q_def, {composed_sql('condition', 60, 240)} as q_con, {composed_sql('procedure', 180, 650)} as q_pro, {composed_sql('refusal', 40, 180)} as q_ref from base),
regular as ({_REGULAR}),
refused as (select *, row_number() over (order by {KEY('refusal', 'line_no')}, line_no) as rank from q where q_ref is not null qualify rank <= {_SET['refusals'] + 1}),
rows as (select 'anchor' as tier, 'anchor' as kind, line_no, '{D.ANCHOR_QUESTION}' as question, chunk_id as evidence_chunk, q_anc as answer, null as reason from {_first('select * from q where q_anc is not null', 'anchor', _SET['anchors'], 'line_no')}
union all select tier, kind, line_no, question, evidence_chunk, answer, null from {_first('select * from regular', 'regular', _SET['answerables'] - _SET['anchors'], 'line_no, kind')}
union all select 'refusal', 'refusal', a.line_no, replace('{D.REFUSAL_QUESTION}', '{{quote}}', substr(a.q_ref, 1, 120)), b.chunk_id, '', '{D.REFUSAL_REASON}' from refused a join refused b on b.rank = a.rank + 1 where a.chunk_id <> b.chunk_id
union all select 'anchor_refusal', 'anchor', line_no, '{D.ANCHOR_REFUSAL_QUESTION}', chunk_id, '', '{D.ANCHOR_REFUSAL_REASON}' from {_first('select * from q', 'anchor-refusal', _SET['anchor_refusals'], 'line_no')})
select tier, kind, line_no, question, evidence_chunk, answer, reason, case when row_number() over (order by {KEY('set', 'line_no', 'tier', 'kind')}, line_no, tier, kind) <= 600 then 'train' else 'eval' end as split, row_number() over (order by {KEY('set', 'line_no', 'tier', 'kind')}, line_no, tier, kind) as r from rows qualify r <= 660""".replace(", row_number() over (order by " + KEY("set", "line_no", "tier", "kind") + ", line_no, tier, kind) as r from rows qualify r <= 660", " from rows qualify row_number() over (order by " + KEY("set", "line_no", "tier", "kind") + ", line_no, tier, kind) <= 660"))
def q_instruction_set(spark, sf_dir):
    """Anchors, regular answerables, refusals and anchor refusals in one set, put in order and cut into train and eval."""
    made = D.instruction_set(D.require_rows(_chunks(spark, sf_dir), 20), 600, 60)
    return made.drop("output")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("select id, type, question, len(evidence_chunk_ids)::bigint as n_ids, notes from eval_set")
def q_jsonl_round_trip(spark, sf_dir):
    """Written as JSON lines and read again, strictly."""
    path = _folder(spark, "jsonl")
    rows = table(spark, sf_dir, "eval_set")
    sinks.write_jsonl(rows, path)
    back = files.read_jsonl(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))
    return back.select("id", "type", "question", F.size("evidence_chunk_ids").cast("long").alias("n_ids"), "notes")


@query("select count(*)::bigint as n_lines from eval_set")
def q_resume_count(spark, sf_dir):
    """Lines that a former run has written, where an appending one goes on."""
    path = _folder(spark, "resume")
    sinks.write_jsonl(table(spark, sf_dir, "eval_set").where("type = 'answerable'"), path)
    sinks.write_jsonl(table(spark, sf_dir, "eval_set").where("type is distinct from 'answerable'"), path, append=True)
    return spark.createDataFrame([(sinks.count_lines(spark, path),)], "n_lines long")


@query("select pair_id, source, prompt from preference_pairs where source is not null")
def q_csv_round_trip(spark, sf_dir):
    """Written as CSV with a header and read again; the prompts hold line breaks, commas and quotes."""
    path = _folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "preference_pairs").where("source is not null").select("pair_id", "source", "prompt"), path)
    return files.read_csv(spark, path, "pair_id long, source string, prompt string")


@query("select entry_key, name, md5(system_prompt) as prompt_md5, len(example)::bigint as n_examples from all_aigame_prompt where system_prompt is not null")
def q_catalogue_round_trip(spark, sf_dir):
    """The catalogue as one indented JSON array, read again as a whole document."""
    path = _folder(spark, "catalogue")
    rows = table(spark, sf_dir, "all_aigame_prompt").where("system_prompt is not null").select("entry_key", "name", "system_prompt", "example")
    spark.createDataFrame([(sinks.json_document(rows),)], "value string").coalesce(1).write.text(path)
    back = files.read_catalogue(spark, path)
    return back.select("entry_key", "name", F.md5("system_prompt").alias("prompt_md5"), F.size("example").cast("long").alias("n_examples"))


@query("select label, count(*)::bigint as n, min(vec_id)::bigint as first_id from embeddings where embedding is not null group by 1")
def q_index_round_trip(spark, sf_dir):
    """An index saved by label, not rebuilt by a second save, and read again."""
    path = _folder(spark, "index")
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    sinks.save_index(rows, path, by="label")
    back = sinks.save_index(rows.limit(0), path, by="label")
    return back.groupBy(F.col("label").cast(rows.schema["label"].dataType).alias("label")).agg(F.count("*").alias("n"), F.min("vec_id").cast("long").alias("first_id"))


@query("select doc_id, upper(lang) as result from documents where lang is not null")
def q_in_batches(spark, sf_dir):
    """A service asked for ten texts at a time; the stand-in answers in capitals."""
    rows = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    return files.in_batches(rows, "lang", lambda part: [x.upper() for x in part]).select("doc_id", "result")


@query("select source as file, row_number() over (order by source) as place from (select distinct source from documents where source is not null)")
def q_file_order(spark, sf_dir):
    """Source files in the order of their names."""
    return files.in_name_order(table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("file")).distinct())
