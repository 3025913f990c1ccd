"""Queries on chunkers, pages and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import chunking as K
from quillgrain.operators import prompts as M
from quillgrain.operators import web as W
from quillgrain.session import table

from .registry import query


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""with n as (select line_no, text, greatest(0, ceil((length(text) - {overlap}) / {step}.0)::bigint - 1) as last from evidence_corpus where text is not null and length(text) > 0),
e as (select line_no, text, unnest(range(0, last + 1)) as i from n) select line_no, i::bigint as place, md5(substr(text, (i * {step} + 1)::bigint, {size})) as piece_md5, length(substr(text, (i * {step} + 1)::bigint, {size}))::bigint as n_chars from e"""


def _window_rows(spark, sf_dir, size, overlap):
    rows = table(spark, sf_dir, "evidence_corpus").where("text is not null").select("line_no", F.posexplode(K.window_chunks(F.col("text"), size, overlap)).alias("place", "piece"))
    return rows.select("line_no", F.col("place").cast("long").alias("place"), F.md5("piece").alias("piece_md5"), F.length("piece").cast("long").alias("n_chars"))


@query(_windows(896, 200))
def q_window_chunks(spark, sf_dir):
    return _window_rows(spark, sf_dir, 896, 200)


@query(_windows(2048, 200))
def q_node_windows_2048(spark, sf_dir):
    return _window_rows(spark, sf_dir, 2048, 200)


@query()
def q_section_chunks(spark, sf_dir):
    return K.chunk_sections(table(spark, sf_dir, "evidence_corpus"))


@query()
def q_recursive_chunks(spark, sf_dir):
    return K.explode_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: [(x,) for x in K.recursive_pieces(t, 896, 200)], "piece string")


@query()
def q_structural_chunks(spark, sf_dir):
    return K.explode_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", K.structural_blocks, "at long, kind string, block string")


HTML = r"regexp_replace(regexp_replace(text, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g'), '<[A-Za-z/!][^<>]*>', '', 'g')"
for _old, _new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_old}', '{_new}')"
HTML = rf"regexp_replace({HTML}, '[\r\n]+', chr(10), 'g')"


@query(f"select doc_id, substr(t, 1, 1024) as content from (select doc_id, {HTML} as t from documents where text is not null) where length(t) > 50")
def q_html_to_text(spark, sf_dir):
    return W.fetched(table(spark, sf_dir, "documents").where("text is not null"), "text").select("doc_id", "content")


URLS = "urls as (select doc_id, lang, 'https://' || source || '.example/' || doc_id::varchar || case when doc_id % 7 = 0 then '.pdf' else '' end as url from documents where lang is not null and source is not null)"


def _urls(spark, sf_dir):
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".pdf").otherwise(""))
    return table(spark, sf_dir, "documents").where("lang is not null and source is not null").select("doc_id", "lang", url.alias("url"))


@query(f"with {URLS}, r as (select *, row_number() over (partition by lang order by doc_id) - 1 as idx from urls where not contains(url, 'forum') and not contains(url, 'chat') and not url like '%.pdf') select lang, url, idx::bigint as idx from r where idx < 20")
def q_url_filter(spark, sf_dir):
    return W.allowed_results(_urls(spark, sf_dir), "lang", "doc_id", "url", ("forum", "chat")).select("lang", "url", "idx")


RESULTS = "results as (select id, unnest(range(len(evidence_chunk_ids)))::bigint as rank, unnest(evidence_chunk_ids) as url, question from eval_set)"


def _results(spark, sf_dir):
    return table(spark, sf_dir, "eval_set").select("id", F.posexplode("evidence_chunk_ids").alias("rank", "url"), "question").withColumn("rank", F.col("rank").cast("long"))


@query(f"with {RESULTS} select url, count(*)::bigint as n, min(id) as first_query, md5(string_agg(question, chr(10) order by id, rank, question)) as snippets_md5 from results group by 1")
def q_union_by_url(spark, sf_dir):
    return W.union_by_url(_results(spark, sf_dir), "url", "id", "rank", "question").select("url", "n", "first_query", F.md5("snippets").alias("snippets_md5"))


@query(f"with {RESULTS} select id, url from results where exists (select 1 from evidence_corpus e where e.chunk_id = url and e.section is not null)")
def q_selected_results(spark, sf_dir):
    chosen = table(spark, sf_dir, "evidence_corpus").where("section is not null").select(F.col("chunk_id").alias("url"))
    return _results(spark, sf_dir).select("id", "url").join(chosen, "url", "left_semi").select("id", "url")


@query(r"select entry_key, regexp_extract(system_prompt, '(?m)^\s*(#{1,2})(?:[^#]|$)', 1) as level from all_aigame_prompt where system_prompt is not null")
def q_heading_level(spark, sf_dir):
    return table(spark, sf_dir, "all_aigame_prompt").where("system_prompt is not null").select("entry_key", T.first_heading_level(F.col("system_prompt")).alias("level"))


@query(r"""select entry_key, case when not regexp_matches(system_prompt, '(?m)^##\s+[一-鿿]+') then '不存在以## 开头的汉字标题' when not regexp_matches(system_prompt, '(?m)^###\s+Prompt') then 'Prompt部分未识别' when len(list_filter(string_split_regex(system_prompt, '(?m)^###\s+效果示例')[2:], lambda p: not (regexp_matches(p, '####\s+Q[：:]') and regexp_matches(p, '####\s+A[：:]')))) > 0 then '效果示例部分的 Q：或 A：未识别' else '格式正确' end as message, replace(name, ':', '：') as name
from all_aigame_prompt where system_prompt is not null""")
def q_template_check(spark, sf_dir):
    return table(spark, sf_dir, "all_aigame_prompt").where("system_prompt is not null").select("entry_key", M.template_check(F.col("system_prompt"))["message"].alias("message"), T.chinese_colons(F.col("name")).alias("name"))


@query(r"select pair_id, regexp_extract(chosen, '(?s)\{.*\}') as object from preference_pairs where chosen is not null")
def q_brace_objects(spark, sf_dir):
    """The first balanced object of a reply; the SQL side takes the first to the last brace, the same on whole objects."""
    return table(spark, sf_dir, "preference_pairs").where("chosen is not null").select("pair_id", T.brace_object(F.col("chosen")).alias("object"))
