"""Queries that build evaluation, instruction and preference records from evidence chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrain.functions import picks as P
from quillgrain.functions import text as T
from quillgrain.operators import builders as D
from quillgrain.operators import evidence as E
from quillgrain.session import table

from .registry import B, query

STRIP = lambda c: f"regexp_replace({c}, '^{B}+|{B}+$', '', 'g')"
SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.?!;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP('x')}), lambda x: x <> '')"
CAND = f"""cand as (select line_no, chunk_id, title, doc_id, section, text, case when len(list_filter(s, lambda x: length(x) between 60 and 240)) > 0 then list_filter(s, lambda x: length(x) between 60 and 240)
 else list_filter(s, lambda x: length(x) between 30 and 300) end as c from (select *, {SENT} as s from evidence_corpus where text is not null))"""
NUM = lambda key, n: f"(('0x' || substr({key}, 1, 8))::bigint % {n})"
KEY = lambda scope, *ids: "md5('1234|" + scope + "|' || " + " || '|' || ".join(f"{i}::varchar" for i in ids) + ")"
QUOTE = f"quoted as (select *, case when len(c) > 0 then c[{NUM(KEY('quote', 'line_no'), 'len(c)')} + 1] end as quote from cand)"
TOPIC = lambda c: f"case when length({c}) > 120 then rtrim(substr({c}, 1, 120), ' ') || '...' else {c} end"


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "evidence_corpus").where("text is not null")


@query(f"select line_no, len(s)::bigint as n_sentences, md5(array_to_string(s, chr(10))) as sentences_md5 from (select line_no, {SENT} as s from evidence_corpus where text is not null)")
def q_sentences(spark, sf_dir):
    s = _chunks(spark, sf_dir).select("line_no", T.sentences(F.col("text")).alias("s"))
    return s.select("line_no", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query(f"with {CAND} select line_no, len(c)::bigint as n_candidates, coalesce(list_max(list_transform(c, lambda x: length(x))), 0)::bigint as longest from cand")
def q_quote_candidates(spark, sf_dir):
    c = _chunks(spark, sf_dir).select("line_no", T.quote_candidates(F.col("text")).alias("c"))
    return c.select("line_no", F.size("c").cast("long").alias("n_candidates"), F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0)).cast("long").alias("longest"))


@query(f"with {CAND}, {QUOTE} select line_no, quote, {TOPIC('quote')} as topic from quoted where quote is not null")
def q_quote_pick(spark, sf_dir):
    return D.picked_quotes(_chunks(spark, sf_dir)).where("quote is not null").select("line_no", "quote", T.shorten(F.col("quote")).alias("topic"))


@query(f"select line_no, {TOPIC('title')} as topic, {TOPIC('text')} as text_topic from evidence_corpus")
def q_topic_truncate(spark, sf_dir):
    return table(spark, sf_dir, "evidence_corpus").select("line_no", T.shorten(F.col("title")).alias("topic"), T.shorten(F.col("text")).alias("text_topic"))


@query(r"""select doc_id, regexp_matches(text, '(?i)\b(is|refers to|defined as)\b') as definition, regexp_matches(text, '(?i)\bshall\b|\bwhen\b|\bif\b') as condition from documents where text is not null""")
def q_trigger_types(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.rlike(T.DEFINITION).alias("definition"), t.rlike(T.CONDITION).alias("condition"))


@query(f"select line_no, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '')[1:10], lambda x: '- ' || x), chr(10)) as steps from evidence_corpus where text is not null")
def q_procedure_bullets(spark, sf_dir):
    return _chunks(spark, sf_dir).select("line_no", T.bullets(F.col("text")).alias("steps"))


TEMPLATES = ", ".join("'" + t.replace("'", "''") + "'" for t in D.QUESTION_TEMPLATES)
RANKED = f"ranked as (select *, row_number() over (order by {KEY('eval', 'line_no')}, line_no) as rank from quoted where quote is not null)"


@query(f"""with {CAND}, {QUOTE}, {RANKED}, t as (select *, case when {NUM(KEY('title', 'line_no'), 4)} = 0 and title is not null and title <> '' then title else {TOPIC('quote')} end as basis from ranked where rank <= 161)
select 'E' || lpad(rank::varchar, 4, '0') as id, 'answerable' as type, chunk_id, quote, replace(([{TEMPLATES}])[{NUM(KEY('template', 'line_no'), 4)} + 1], '{{topic}}', basis) as question from t""")
def q_eval_answerable(spark, sf_dir):
    return D.answerable_questions(D.picked_quotes(_chunks(spark, sf_dir)), 161)


@query(f"""with {CAND}, {QUOTE}, {RANKED}, t as (select * from ranked where rank <= 80)
select 'U' || lpad(a.rank::varchar, 4, '0') as id, 'unanswerable' as type, a.chunk_id as question_chunk, b.chunk_id as evidence_chunk, a.quote from t a join t b on b.rank = a.rank % 80 + 1 where a.chunk_id <> b.chunk_id""")
def q_eval_unanswerable_mismatch(spark, sf_dir):
    return D.mismatched_questions(D.picked_quotes(_chunks(spark, sf_dir)), 80)


OBJ = """'{"answer":' || to_json(quote) || ',"citations":[{"doc_id":' || to_json(coalesce(doc_id,'')) || ',"section":' || to_json(coalesce(section,'')) || ',"chunk_id":' || to_json(coalesce(chunk_id,'')) || ',"quote":' || to_json(quote) || '}],"confidence":"high","cannot_answer_reason":null}'"""
BLOCK = "'[chunk_id=' || coalesce(chunk_id, 'None') || ' doc_id=' || coalesce(doc_id, 'None') || ' section=' || coalesce(section, 'None') || ']' || chr(10) || text"


@query(f"with {CAND}, {QUOTE} select line_no, md5('问题: ' || {TOPIC('quote')} || chr(10) || '证据:' || chr(10) || {BLOCK} || chr(10)) as input_md5, json_extract_string(o, '$.answer') as answer, json_extract_string(o, '$.citations[0].chunk_id') as chunk_id, length(o)::bigint as n_chars from (select *, {OBJ} as o from quoted where quote is not null)")
def q_sft_rows(spark, sf_dir):
    rows = D.instruction_rows(D.picked_quotes(_chunks(spark, sf_dir)).where("quote is not null"))
    o = F.try_parse_json("output")
    return rows.select("line_no", F.md5("input").alias("input_md5"), F.variant_get(o, "$.answer", "string").alias("answer"), F.variant_get(o, "$.citations[0].chunk_id", "string").alias("chunk_id"), F.length("output").cast("long").alias("n_chars"))


@query(f"select sample_id, case when row_number() over (order by {KEY('split', 'sample_id')} || '|' || sample_id) <= 500 then 'eval' else 'train' end as split from sft_conversations")
def q_split_train_eval(spark, sf_dir):
    return P.split_first(table(spark, sf_dir, "sft_conversations").select("sample_id"), "split", 500, ["sample_id"], "eval", "train")


@query("select type, count(*)::bigint as n from eval_set group by 1")
def q_type_mix(spark, sf_dir):
    return table(spark, sf_dir, "eval_set").groupBy("type").agg(F.count("*").alias("n"))


@query("select n_name, r_name, l.i as loop_no, '祝' || n_name || r_name || case when l.i = 0 then '' else ',简短风格' end as label from nation, region, (select unnest([0, 1])::bigint as i) l")
def q_name_scene_cross(spark, sf_dir):
    """Every name with every scene, twice: three catalogues of fixed size."""
    return D.wish_requests(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), 2)


@query(f"""with s as (select sample_id, sample_type, row_number() over (partition by sample_type order by {KEY('mix', 'sample_id')}, sample_id) as r from sft_conversations where sample_type in ('answerable', 'unanswerable'))
select sample_id, sample_type as tier from s where (sample_type = 'answerable' and r <= 300) or (sample_type = 'unanswerable' and r <= 100)""")
def q_sft_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "sft_conversations").select("sample_id", F.col("sample_type").alias("tier"))
    return D.capped_mix(rows, "tier", {"answerable": 300, "unanswerable": 100}, "mix", "sample_id").select("sample_id", "tier")


@query(f"select line_no, case when length(text) >= 60 then substr(text, ({NUM(KEY('window', 'line_no'), '(length(text) - 59)')} + 1)::bigint, 60) end as quote, true as exact from evidence_corpus where text is not null and length(text) >= 60")
def q_quote_exact_windows(spark, sf_dir):
    """The window tier of the exact quote pick: always a substring of its chunk."""
    n = F.length("text")
    at = (P.pick_number(P.pick_key("window", F.col("line_no")), (n - 59).cast("long")) + 1).cast("int")
    rows = _chunks(spark, sf_dir).where(n >= 60).select("line_no", "text", F.substr("text", at, F.lit(60)).alias("quote"))
    return rows.select("line_no", "quote", F.contains("text", "quote").alias("exact"))


LINESQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '')"


@query(f"""with l as (select line_no, {LINESQL} as s from evidence_corpus where text is not null),
w as (select line_no, list_filter(s, lambda x: length(x) between 40 and 200) as one, list_filter([s[i] || chr(10) || s[i + 1] for i in range(1, len(s))], lambda x: length(x) between 40 and 200) as two from l)
select line_no, case when len(one) > 0 then one[{NUM(KEY('tier', 'line_no'), 'len(one)')} + 1] when len(two) > 0 then two[{NUM(KEY('tier', 'line_no'), 'len(two)')} + 1] end as quote from w""")
def q_quote_line_tiers(spark, sf_dir):
    return _chunks(spark, sf_dir).select("line_no", D.line_tier_quote(F.col("text"), P.pick_key("tier", F.col("line_no")), 40, 200, 2).alias("quote"))


@query(f"select id, row_number() over (order by {KEY('limit', 'id')}, id)::bigint as rank from eval_set qualify rank <= 20")
def q_limited_eval(spark, sf_dir):
    return P.first_by_hash(table(spark, sf_dir, "eval_set").select("id"), "limit", 20, "id").select("id", "rank")


@query(f"with r as (select entry_key, row_number() over (order by {KEY('sample', 'entry_key')}, entry_key) - 1 as i from all_aigame_prompt qualify i < 50) select d.draw::bigint as draw, r.entry_key from (select unnest(range(100)) as draw) d join r on r.i = (('0x' || substr(md5('1234|draw|' || d.draw::varchar), 1, 8))::bigint % (select count(*) from r))")
def q_sampling(spark, sf_dir):
    """A sample without replacement of 50 entries, and 100 draws with replacement from it."""
    return D.draws(P.first_by_hash(table(spark, sf_dir, "all_aigame_prompt").select("entry_key"), "sample", 50, "entry_key"), 100)
