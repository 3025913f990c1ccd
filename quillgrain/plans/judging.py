"""Queries on evidence lookups, citations, answer scores and metric reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import evidence as E
from quillgrain.operators import metrics as M
from quillgrain.session import table

from .building import STRIP
from .registry import query

CHUNKS = "chunks as (select chunk_id, arg_max(struct_pack(doc_id := doc_id, section := section, text := text), line_no) as c from evidence_corpus where chunk_id is not null group by 1)"
BLOCKS = "'[chunk_id=' || w.chunk_id || ' doc_id=' || coalesce(c.doc_id, 'None') || ' section=' || coalesce(c.section, 'None') || ']' || chr(10) || coalesce(c.text, '')"
WANTED = "wanted as (select id, unnest(range(len(evidence_chunk_ids))) as pos, unnest(evidence_chunk_ids) as chunk_id from eval_set)"
GRAMS = lambda t: rf"(select case when len(w) >= 3 then list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) else []::varchar[] end from (select regexp_extract_all(lower({t}), '[a-z0-9_\-]+') as w))"
PARTS = ("doc_id", "section", "chunk_id", "quote")
LACKS = " ".join(f"when exists (select 1 from (select unnest(json_extract(o, '$.citations[*]')) as x) where coalesce(json_type(x, '$.{p}'), '') <> 'VARCHAR') then 'citation without text {p}'" for p in PARTS)
JUDGED = f"""{CHUNKS},
both_ as (select pair_id, field, meta.type as kind, meta.evidence_chunk_ids as ids, reply from (select pair_id, meta, 'chosen' as field, chosen as reply from preference_pairs union all select pair_id, meta, 'rejected', rejected from preference_pairs)),
cut as (select *, regexp_extract(reply, '(?s)\\{{.*\\}}') as raw from both_),
objs as (select *, case when raw <> '' and json_valid(raw) and not regexp_matches(raw, ',\\s*[}}\\]]') then raw::json end as o from cut),
vals as (select *, json_extract_string(o, '$.answer') as answer, json_extract_string(o, '$.cannot_answer_reason') as reason, coalesce(json_array_length(o, '$.citations'), 0)::bigint as n_citations,
 case when o is null or json_type(o) <> 'OBJECT' then 'not an object' {" ".join(f"when json_type(o, '$.{k}') is null then 'missing {k}'" for k in ("answer", "citations", "confidence", "cannot_answer_reason"))}
 when json_type(o, '$.answer') <> 'VARCHAR' then 'answer is not text' when json_type(o, '$.citations') <> 'ARRAY' then 'citations is not a list'
 {LACKS} when coalesce(json_extract_string(o, '$.confidence'), '') not in ('low', 'mid', 'high') then 'confidence is not low, mid or high'
 when json_type(o, '$.cannot_answer_reason') not in ('VARCHAR', 'NULL') then 'cannot_answer_reason is not text or null'
 when json_type(o, '$.cannot_answer_reason') = 'NULL' and json_array_length(o, '$.citations') = 0 then 'answerable without citations' else 'ok' end as message from objs),
cits as (select pair_id, field, unnest(range(n_citations)) as pos, unnest(json_extract(o, '$.citations[*]')) as x from vals where n_citations > 0),
cit as (select pair_id, field, pos, json_extract_string(x, '$.chunk_id') as chunk_id, json_extract_string(x, '$.quote') as quote from cits),
exact_ as (select cit.*, coalesce(contains(chunks.c.text, quote) and quote <> '', false) as exact from cit left join chunks using (chunk_id)),
flags as (select pair_id, field, list(exact order by pos) as f from exact_ group by all),
want as (select pair_id, unnest(range(len(meta.evidence_chunk_ids))) as pos, unnest(meta.evidence_chunk_ids) as chunk_id from preference_pairs),
evid as (select w.pair_id, string_agg({BLOCKS}, chr(10) || chr(10) order by w.pos) as evidence from want w join chunks on w.chunk_id = chunks.chunk_id group by 1),
gram as (select v.pair_id, v.field, {GRAMS("coalesce(v.answer, '')")} as a, {GRAMS("coalesce(e.evidence, '')")} as b from vals v left join evid e using (pair_id)),
judged as (select v.pair_id, v.field, v.kind, o is not null as parsed_ok, message = 'ok' as valid, message, n_citations, coalesce(len(list_filter(f, lambda x: x)), 0)::bigint as n_exact, coalesce(f[1], false) as first_exact,
 round(case when len(a) > 0 then len(list_intersect(a, b)) / len(a)::double else 0 end, 6) as covered, coalesce({STRIP('reason')} <> '', false) and n_citations = 0 as refused, reply, reason, coalesce(f, []::boolean[]) as f
 from vals v left join flags using (pair_id, field) join gram using (pair_id, field)),
scored as (select *, (case when reply is null or {STRIP('reply')} = '' then -10 when not parsed_ok then -8 else 2 + (case when valid then 2 else -2 end) + case when coalesce(kind = 'unanswerable', false)
 then (case when coalesce({STRIP('reason')} <> '', false) then 2 else -3 end) + (case when n_citations = 0 then 1 else -2 end) + (case when len(list_filter(f, lambda x: not x)) > 0 then -5 else 0 end)
 else (case when reason is null then 0 else -4 end) + (case when n_citations > 0 then 1 else -4 end) + coalesce(list_sum(list_transform(f[1:3], lambda x: case when x then 3 else -5 end)), 0) + (case when covered >= 0.3 then 2 when covered >= 0.15 then 1 else -2 end) end end)::bigint as score from judged)"""


def _answers(spark, sf_dir):
    return E.answers(table(spark, sf_dir, "preference_pairs"), E.chunk_map(table(spark, sf_dir, "evidence_corpus")))


def _looked_up(spark, sf_dir):
    return E.lookup_evidence(table(spark, sf_dir, "eval_set"), "id", "evidence_chunk_ids", E.chunk_map(table(spark, sf_dir, "evidence_corpus")))


@query(f"with {CHUNKS}, {WANTED} select w.id, count(*)::bigint as n_ids, count(chunks.chunk_id)::bigint as n_found, md5(coalesce(string_agg({BLOCKS}, chr(10) || chr(10) order by w.pos) filter (where chunks.chunk_id is not null), '')) as evidence_md5 from wanted w left join chunks on w.chunk_id = chunks.chunk_id group by 1")
def q_evidence_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("id", "n_ids", F.size("found").cast("long").alias("n_found"), F.md5(E.evidence_text(F.col("found"))).alias("evidence_md5"))


@query(f"with {CHUNKS}, {WANTED}, m as (select w.id, w.chunk_id from wanted w where not exists (select 1 from chunks where chunks.chunk_id = w.chunk_id)) select id, count(*)::bigint as n_missing from m group by 1")
def q_missing_evidence(spark, sf_dir):
    wanted = table(spark, sf_dir, "eval_set").select("id", F.explode("evidence_chunk_ids").alias("chunk_id"))
    return wanted.join(E.chunk_map(table(spark, sf_dir, "evidence_corpus")).select("chunk_id"), "chunk_id", "left_anti").groupBy("id").agg(F.count("*").alias("n_missing"))


@query(f"with {JUDGED} select pair_id, field, pos::bigint as pos, chunk_id, exact from exact_")
def q_citation_exact_match(spark, sf_dir):
    pairs = table(spark, sf_dir, "preference_pairs")
    both = F.explode(F.array(F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("reply")), F.struct(F.lit("rejected").alias("field"), F.col("rejected").alias("reply"))))
    rows = pairs.select("pair_id", both.alias("r")).select("pair_id", "r.field", E.field(E.parsed(F.col("r.reply")), "citations", E.CITATIONS).alias("cits"))
    return E.cited(rows, ["pair_id", "field"], "cits", E.chunk_map(table(spark, sf_dir, "evidence_corpus"))).select("pair_id", "field", F.col("pos").cast("long").alias("pos"), "chunk_id", "exact")


@query(f"with {JUDGED} select pair_id, field, covered from judged")
def q_ngram_coverage(spark, sf_dir):
    return _answers(spark, sf_dir).select("pair_id", "field", "covered")


@query(f"with {JUDGED} select pair_id, field, message from judged")
def q_schema_validate(spark, sf_dir):
    return _answers(spark, sf_dir).select("pair_id", "field", "message")


@query(f"with {JUDGED} select pair_id, field, score from scored")
def q_candidate_scores(spark, sf_dir):
    return _answers(spark, sf_dir).select("pair_id", "field", "score")


PAIRED = "pairs as (select a.pair_id, a.score as sa, b.score as sb from scored a join scored b on a.pair_id = b.pair_id and a.field = 'chosen' and b.field = 'rejected')"


@query(f"with {JUDGED}, {PAIRED} select pair_id, case when sa > sb then 'chosen' else 'rejected' end as better, greatest(sa, sb) as score_chosen, least(sa, sb) as score_rejected, abs(sa - sb)::bigint as margin from pairs where abs(sa - sb) >= 3")
def q_preference_pairs(spark, sf_dir):
    return M.preferences(_answers(spark, sf_dir), 3)


@query(f"with {JUDGED}, {PAIRED} select count(*)::bigint as tried, count(*) filter (where abs(sa - sb) >= 3)::bigint as kept, round(count(*) filter (where abs(sa - sb) >= 3) / greatest(1, count(*))::double, 6) as keep_rate, round(avg(abs(sa - sb)) filter (where abs(sa - sb) >= 3), 6) as mean_margin from pairs")
def q_pair_report(spark, sf_dir):
    return M.pair_report(M.preferences(_answers(spark, sf_dir), 0), 3)


RATES = """count(*)::bigint as n, round(count(*) filter (where parsed_ok) / greatest(1, count(*))::double, 6) as parse_rate, round(count(*) filter (where valid) / greatest(1, count(*))::double, 6) as schema_rate,
 round(coalesce(sum(n_exact) / nullif(sum(n_citations), 0)::double, 0), 6) as citation_rate, round(count(*) filter (where covered >= 0.2) / greatest(1, count(*))::double, 6) as grounded_rate,
 round(coalesce(count(*) filter (where kind = 'unanswerable' and parsed_ok and refused) / nullif(count(*) filter (where kind = 'unanswerable' and parsed_ok), 0)::double, 0), 6) as refusal_rate"""


@query(f"with {JUDGED} select field as model, {RATES} from scored group by 1")
def q_eval_metrics(spark, sf_dir):
    return M.metrics(_answers(spark, sf_dir), "field")


@query(f"""with {JUDGED}, r as (select count(*)::bigint as total, count(*) filter (where refused)::bigint as refusals, round(count(*) filter (where parsed_ok) / greatest(1, count(*))::double, 6) as parse_rate,
 round(count(*) filter (where valid) / greatest(1, count(*))::double, 6) as schema_rate, round(count(*) filter (where first_exact and not refused) / greatest(1, count(*) - count(*) filter (where refused))::double, 6) as quote_rate,
 round(count(*) filter (where refused) / greatest(1, count(*))::double, 6) as refusal_ratio from scored where field = 'chosen')
select *, parse_rate >= 0.99 as parse_ok, quote_rate >= 0.95 as quote_ok, refusal_ratio between 0.15 and 0.3 as refusal_ok from r""")
def q_quality_report(spark, sf_dir):
    return M.quality_report(_answers(spark, sf_dir).where("field = 'chosen'"))


LONG = "long as (select model, metric, value from (unpivot m on parse_rate, schema_rate, citation_rate, grounded_rate, refusal_rate into name metric value value))"


@query(f"""with {JUDGED}, m as (select field as model, {RATES} from scored group by 1), {LONG}, w as (select metric, max(value) filter (where model = 'rejected') as base, max(value) filter (where model = 'chosen') as now from long group by 1)
select metric, base, now, case when base is null or base = 0 then '' when (now - base) / base > 0.1 then 'up' when (now - base) / base < -0.1 then 'down' else 'flat' end as trend, now - base >= 0.01 as improved from w""")
def q_metric_compare(spark, sf_dir):
    return M.compare(M.metrics(_answers(spark, sf_dir), "field"), "rejected", "chosen")


@query(f"""with {JUDGED} select field, case when not parsed_ok then 'invalid json' when refused and kind = 'answerable' then 'false refusal' when n_exact < n_citations then 'bad citation' when kind = 'unanswerable' and not refused then 'fabricated' else 'fine' end as failure, count(*)::bigint as n from scored group by all""")
def q_failure_classes(spark, sf_dir):
    return M.failures(_answers(spark, sf_dir), "field")


@query("""select count(*)::bigint as n_chunks, round(avg(length(text)), 6) as mean_len, min(length(text))::bigint as min_len, max(length(text))::bigint as max_len, count(*) filter (where length(text) < 120)::bigint as n_tiny,
 count(*) filter (where length(text) > 2200)::bigint as n_over, count(distinct section)::bigint as n_sections from evidence_corpus where text is not null""")
def q_corpus_stats(spark, sf_dir):
    return M.corpus_stats(table(spark, sf_dir, "evidence_corpus"))


@query("with t as (select doc_id, avg(toxic) as toxic, avg(quality) as quality from labels group by 1) select doc_id, toxic = 0 and quality >= 3 as relevant from t where toxic is not null and quality is not null")
def q_label_filter(spark, sf_dir):
    """Relevance filter with the reviewed labels as the model's verdict, positive and negated."""
    t = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"), F.avg("quality").alias("quality")).where("toxic is not null and quality is not null")
    return t.select("doc_id", ((F.col("toxic") == 0) & (F.col("quality") >= 3)).alias("relevant"))


@query("select log_id, received_at, contains(coalesce(parsed_output, ''), 'true') as says_true from call_log where raw_output is not null")
def q_truth_substring(spark, sf_dir):
    return table(spark, sf_dir, "call_log").where("raw_output is not null").select("log_id", "received_at", T.says_true(F.coalesce("parsed_output", F.lit(""))).alias("says_true"))
