"""Queries on lines, sections, chunk names and script counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import sections as S
from quillgrain.session import table

from .registry import LINES, B, query

PAGE = "(regexp_matches(line, '^[0-9]+$') or regexp_matches(line, '(?i)^page[ ]+[0-9]+([ ]+of[ ]+[0-9]+)?[ ]*$'))"
NOISE = "(line = '' or length(line) - length(replace(line, '|', '')) >= 3 or regexp_matches(line, '[┌┐└┘─│]'))"
TOC = "regexp_matches(line, '[ ][0-9]{1,4}$')"
HEAD = r"'^(Annex [A-Z]|[A-Z]\.[0-9]+(?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)*)([^\pL\pN_].*)?$'"
CLEAN = f"""rep as (select doc_id, line from norm where length(line) between 1 and 80 and not {PAGE} group by all having count(*) >= 2),
clean as (select n.* from norm n where not ({PAGE} or {NOISE} or {TOC}) and not exists (select 1 from rep r where r.doc_id = n.doc_id and r.line = n.line)),
head as (select *, nullif(regexp_extract(line, {HEAD}, 1), '') as sec, nullif(ltrim(regexp_extract(line, {HEAD}, 2), ' '), '') as tit from clean),
carried as (select doc_id, line_no, line, sec, last_value(case when sec is not null then struct_pack(s := sec, t := tit) end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as h from head)"""


def _lines(spark, sf_dir):
    return S.explode_lines(table(spark, sf_dir, "documents"))


@query(f"with {LINES} select doc_id, line_no, line, length(line)::bigint as n_chars from norm")
def q_normalize_lines(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("n_chars", F.length("line").cast("long"))


@query(f"""with {LINES} select doc_id, line_no, {PAGE} as is_page, {NOISE} as is_table, {TOC} as is_toc,
 nullif(regexp_extract(line, {HEAD}, 1), '') as section, nullif(ltrim(regexp_extract(line, {HEAD}, 2), ' '), '') as title from norm""")
def q_line_flags(spark, sf_dir):
    line = F.col("line")
    section, title = T.heading(line)
    return _lines(spark, sf_dir).select("doc_id", "line_no", T.is_page_number(line).alias("is_page"), T.is_table_noise(line).alias("is_table"), T.is_toc_like(line).alias("is_toc"), section.alias("section"), title.alias("title"))


@query(f"with {LINES} select doc_id, line, count(*)::bigint as n from norm where length(line) between 1 and 80 and not {PAGE} group by all having count(*) >= 2")
def q_repeated_lines(spark, sf_dir):
    return S.repeated_lines(_lines(spark, sf_dir), min_count=2)


@query(f"with {LINES}, {CLEAN} select doc_id, line_no, line from clean")
def q_clean_lines(spark, sf_dir):
    return S.clean_lines(_lines(spark, sf_dir), min_count=2).select("doc_id", "line_no", "line")


@query(f"with {LINES}, {CLEAN} select doc_id, line_no, h.s as section, h.t as title, line from carried where sec is null")
def q_section_carry_forward(spark, sf_dir):
    return S.carry_sections(S.clean_lines(_lines(spark, sf_dir), min_count=2))


@query(f"""with {LINES}, {CLEAN}, a as (select doc_id, count(*)::bigint as lines_in from norm group by 1),
b as (select doc_id, count(*)::bigint as lines_kept, count(distinct h.s)::bigint as n_sections, sum(length(line))::bigint as chars_kept from carried where sec is null group by 1)
select a.doc_id, lines_in, coalesce(lines_kept, 0) as lines_kept, coalesce(n_sections, 0) as n_sections, coalesce(chars_kept, 0) as chars_kept from a left join b using (doc_id)""")
def q_clean_corpus_stats(spark, sf_dir):
    """Lines read and kept, sections and characters of every document."""
    lines = _lines(spark, sf_dir)
    kept = S.carry_sections(S.clean_lines(lines, min_count=2)).groupBy("doc_id").agg(F.count("*").alias("lines_kept"), F.countDistinct("section").alias("n_sections"), F.sum(F.length("line")).alias("chars_kept"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines_in")).join(kept, "doc_id", "left").select("doc_id", "lines_in", zero("lines_kept"), zero("n_sections"), zero("chars_kept"))


UNIT = f"""unit as (select doc_id, case when section is null or section = '' then 'UNKNOWN' else regexp_replace(section, '^{B}+|{B}+$', '', 'g') end as section, title, line_no, text
 from evidence_corpus where doc_id is not null and text is not null and regexp_replace(text, '^{B}+|{B}+$', '', 'g') <> '')"""


@query(f"""with {UNIT} select doc_id, section, min(line_no)::bigint as first_line, arg_min(struct_pack(t := title), line_no).t as title, count(*)::bigint as n_parts, sum(length(text))::bigint as n_chars,
 md5(string_agg(text, chr(10) order by line_no)) as text_md5 from unit group by all""")
def q_section_groups(spark, sf_dir):
    c = F.col
    g = S.group_sections(table(spark, sf_dir, "evidence_corpus"), c("doc_id"), c("section"), c("title"), c("line_no"), c("text"))
    return g.select("doc_id", "section", "first_line", "title", "n_parts", "n_chars", F.md5(F.array_join("texts", "\n")).alias("text_md5"))


@query(f"""with {UNIT}, r as (select *, row_number() over (partition by doc_id, section order by line_no) as i from unit)
select line_no, coalesce(nullif(substr(upper(regexp_replace(doc_id, '[^0-9A-Za-z]', '', 'g')), 1, 24), ''), 'DOC') || '-' || regexp_replace(section, '[^0-9A-Za-z.]', '', 'g') || '-' || case when i > 9999 then i::varchar else lpad(i::varchar, 4, '0') end as chunk_id from r""")
def q_chunk_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "evidence_corpus").where("doc_id is not null and text is not null").where(T.strip(F.col("text")) != "").withColumn("s", T.section_or_unknown(F.col("section")))
    index = F.row_number().over(Window.partitionBy("doc_id", "s").orderBy("line_no"))
    return rows.withColumn("i", index).select("line_no", T.chunk_id(F.col("doc_id"), F.col("s"), F.col("i")).alias("chunk_id"))


def _sql_transcript(col: str) -> str:
    out = col
    for pattern, new in T.TRANSCRIPT_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"trim(regexp_replace({out}, '{B}+', ' ', 'g'), ' ')"
    out = rf"regexp_replace({out}, ' ([.,!?;:])', '\1', 'g')"
    out = rf"regexp_replace({out}, '([.,!?;:]) ', '\1', 'g')"
    out = rf"regexp_replace({out}, '([^ ]) +([^ ])', '\1,\2', 'g')"
    return rf"regexp_replace(replace({out}, '。,', '。'), '[^\pL\pN\pM_\s.,!?;:]', '', 'g')"


@query(f"select doc_id, length(t)::bigint as n_chars, md5(t) as cleaned_md5 from (select doc_id, {_sql_transcript('text')} as t from documents where text is not null)")
def q_transcript_clean(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.clean_transcript(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("cleaned_md5"))


@query("select doc_id, n_cjk, n_cjk >= 120 as kept from (select doc_id, (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')))::bigint as n_cjk from documents where text is not null)")
def q_script_char_filter(spark, sf_dir):
    """Kept and rejected documents in one flagged result: the split is written twice, inputs never move."""
    n = T.count_cjk(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n.alias("n_cjk")).withColumn("kept", F.col("n_cjk") >= 120)


@query("select event_type, count(*)::bigint as n, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k, count(json_extract_string(props, '$.k'))::bigint as n_k from events group by 1")
def q_json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.try_cast("long")).alias("sum_k"), F.count(k).alias("n_k"))


@query("select doc_id, source, sha256(text) as sha256, length(text)::bigint as n_chars from documents where text is not null")
def q_doc_hash_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))


@query("select sha256(text) as sha256, count(*)::bigint as n_copies, min(doc_id)::bigint as kept_doc from documents where text is not null group by 1 having count(*) > 1")
def q_exact_dup_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("kept_doc")).where("n_copies > 1")
