"""Queries on conversations, prompts and catalogue records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.operators import conversations as C
from quillgrain.operators import evidence as E
from quillgrain.session import table

from .building import STRIP
from .registry import query

TURNS = "turns as (select sample_id, unnest(range(1, len(conversation) + 1))::bigint as turn_no, unnest(conversation) as t from sft_conversations)"
MSGS = f"""{TURNS}, msgs as (select sample_id, 2 * (turn_no - 1) as place, 'user' as role, t.input as text from turns union all select sample_id, 2 * (turn_no - 1) + 1, 'assistant', t.output from turns)"""


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "sft_conversations")


def _messages(spark, sf_dir):
    return C.messages(_samples(spark, sf_dir))


@query(f"with {MSGS}, n as (select *, lead(text) over (partition by sample_id order by place) as reply from msgs) select sample_id, place::bigint as place, md5(coalesce(text, '')) as asked, md5(coalesce(reply, '')) as answered from n where role = 'user'")
def q_conv_pairs(spark, sf_dir):
    """User and assistant messages paired; both sit in one turn, so no window is needed."""
    return C.turns(_samples(spark, sf_dir)).select("sample_id", (2 * (F.col("turn_no") - 1)).alias("place"), F.md5(F.coalesce("input", F.lit(""))).alias("asked"), F.md5(F.coalesce("output", F.lit(""))).alias("answered"))


@query(f"with {TURNS} select sample_id, turn_no, md5(t.input) as instruction, '' as input, md5(t.output) as output from turns where t.input is not null and t.output is not null")
def q_instruct_rows(spark, sf_dir):
    return C.instruct_rows(_samples(spark, sf_dir)).withColumns({"instruction": F.md5("instruction"), "output": F.md5("output")})


@query(f"with {TURNS} select sample_id, turn_no, 1::bigint as n_turns, length(coalesce(t.system, '')) + length(coalesce(t.input, '')) + length(coalesce(t.output, ''))::bigint as n_chars from turns")
def q_merge_rewrap(spark, sf_dir):
    one = F.col("conversation")[0]
    size = F.length(F.coalesce(one["system"], F.lit(""))) + F.length(F.coalesce(one["input"], F.lit(""))) + F.length(F.coalesce(one["output"], F.lit("")))
    return C.single_turns(_samples(spark, sf_dir)).select("sample_id", "turn_no", F.size("conversation").cast("long").alias("n_turns"), size.cast("long").alias("n_chars"))


@query("select sample_id from sft_conversations where len(list_filter(conversation, lambda t: coalesce(length(t.output), 0) < 60)) = 0 and conversation is not null")
def q_drop_short_groups(spark, sf_dir):
    return C.drop_short(_samples(spark, sf_dir), 60).select("sample_id")


@query(f"with {MSGS} select sample_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, ''), chr(10) order by place)) as history_md5 from msgs group by 1")
def q_history_render(spark, sf_dir):
    return C.render_history(_messages(spark, sf_dir), "sample_id", "place", F.initcap("role"), F.col("text")).select("sample_id", F.md5("history").alias("history_md5"))


@query(f"with {MSGS} select sample_id, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) order by place)) as history_md5 from msgs group by 1")
def q_chat_template(spark, sf_dir):
    return C.chat_template(_messages(spark, sf_dir), "sample_id", "place", F.col("role"), F.col("text")).select("sample_id", F.md5("history").alias("history_md5"))


@query(f"with {MSGS} select sample_id, md5(coalesce(arg_max(coalesce(text, ''), place), '')) as last_md5 from msgs group by 1")
def q_last_message(spark, sf_dir):
    return E.last_message(_messages(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "sample_id", "place", "text").select("sample_id", F.md5("text").alias("last_md5"))


@query(f"with {MSGS}, r as (select *, row_number() over (partition by sample_id order by place desc) as back from msgs) select sample_id, place::bigint as place, role from r where back > 2")
def q_drop_last_two(spark, sf_dir):
    return C.drop_last(_messages(spark, sf_dir), "sample_id", "place").select("sample_id", "place", "role")


@query(f"with {MSGS}, n as (select *, count(*) over (partition by sample_id) as n from msgs) select sample_id, place::bigint as place, role from n where n <= 4")
def q_history_reset(spark, sf_dir):
    return C.keep_recent(_messages(spark, sf_dir), "sample_id", "place", 4).select("sample_id", "place", "role")


@query(f"select sample_id, coalesce(nullif({STRIP('conversation[1].system')}, ''), 'default') as system, md5({STRIP('conversation[1].input')}) as input_md5 from sft_conversations where len(conversation) > 0")
def q_system_default(spark, sf_dir):
    first = _samples(spark, sf_dir).select("sample_id", C.first_turn(F.col("conversation"), "default").alias("t")).where("t is not null")
    return first.select("sample_id", "t.system", F.md5("t.input").alias("input_md5"))


@query(f"with {TURNS} select sample_id, turn_no, 'You are concise.' as system, length(t.output)::bigint as n_chars from turns")
def q_system_rewrite(spark, sf_dir):
    rewritten = _samples(spark, sf_dir).withColumn("conversation", C.with_system(F.col("conversation"), F.lit("You are concise.")))
    return C.turns(rewritten).select("sample_id", "turn_no", "system", F.length("output").cast("long").alias("n_chars"))


WORDS = lambda t: rf"list_transform(regexp_extract_all(coalesce({t}, ''), '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'), lambda w: (('0x' || substr(md5(w), 1, 8))::bigint % 50000))"


@query(f"""with {TURNS}, w as (select sample_id, turn_no, {WORDS("coalesce(t.system, '') || chr(10) || coalesce(t.input, '')")} as p, {WORDS('t.output')}[1:128] as o from turns),
k as (select *, greatest(0, 512 - len(o)) as room from w), c as (select *, case when len(p) > room then p[(len(p) - room + 1)::bigint:] else p end as kept from k)
select sample_id, turn_no, (len(kept) + len(o))::bigint as n_tokens, len(kept)::bigint as n_masked, (coalesce(list_sum(kept), 0) + coalesce(list_sum(o), 0))::bigint as sum_ids, (coalesce(list_sum(o), 0) - 100 * len(kept))::bigint as sum_labels from c""")
def q_tokenize_mask(spark, sf_dir):
    rows = C.turns(_samples(spark, sf_dir)).select("sample_id", "turn_no", C.word_ids(F.concat(F.coalesce("system", F.lit("")), F.lit("\n"), F.coalesce("input", F.lit("")))).alias("p"), C.word_ids(F.col("output")).alias("o"))
    t = rows.select("sample_id", "turn_no", C.tokenize_masked(F.col("p"), F.col("o"), 512, 128).alias("t"))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return t.select("sample_id", "turn_no", F.size("t.attention_mask").cast("long").alias("n_tokens"), F.size(F.filter("t.labels", lambda x: x == -100)).cast("long").alias("n_masked"), total("t.input_ids").alias("sum_ids"), total("t.labels").alias("sum_labels"))


@query(f"""with {TURNS}, w as (select sample_id, turn_no, {WORDS('t.input')} as p, {WORDS('t.output')} as o from turns), c as (select *, list_concat(list_concat(p, o), [50000])[1:256] as ids, list_concat(list_concat(list_transform(p, lambda x: -100::bigint), o), [50000])[1:256] as labels from w)
select sample_id, turn_no, len(ids)::bigint as n_tokens, list_sum(ids)::bigint as sum_ids, list_sum(labels)::bigint as sum_labels from c""")
def q_tokenize_mask_right(spark, sf_dir):
    rows = C.turns(_samples(spark, sf_dir)).select("sample_id", "turn_no", C.tokenize_right(C.word_ids(F.col("input")), C.word_ids(F.col("output")), 50_000, 256).alias("t"))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("sample_id", "turn_no", F.size("t.input_ids").cast("long").alias("n_tokens"), total("t.input_ids").alias("sum_ids"), total("t.labels").alias("sum_labels"))


@query(f"""with {TURNS}, w as (select sample_id, turn_no, {WORDS('t.input')} as p, {WORDS('t.output')} as o from turns), c as (select *, list_concat(list_concat(p, o), [50000])[1:256] as ids, list_concat(list_concat(list_transform(p, lambda x: -100::bigint), o), [50000])[1:256] as labels, substr(sample_id, 1, length(sample_id) - 1) as batch from w),
b as (select *, max(len(ids)) over (partition by batch) as padded from c)
select sample_id, turn_no, batch, len(ids)::bigint as n_tokens, padded::bigint as padded, list_sum(ids)::bigint as sum_ids, (list_sum(labels) - 100 * (padded - len(ids)))::bigint as sum_labels, case when padded > len(ids) then 0 else ids[-1] end::bigint as last_id from b""")
def q_pad_batch(spark, sf_dir):
    """Every turn padded to its batch: ids with 0, the mask with 0, labels with -100."""
    rows = C.turns(_samples(spark, sf_dir)).select("sample_id", "turn_no", F.expr("substr(sample_id, 1, length(sample_id) - 1)").alias("batch"), C.tokenize_right(C.word_ids(F.col("input")), C.word_ids(F.col("output")), 50_000, 256).alias("t"))
    padded = C.pad_batches(rows, "batch", "t")
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return padded.select("sample_id", "turn_no", "batch", total("t.attention_mask").alias("n_tokens"), F.size("t.labels").cast("long").alias("padded"), total("t.input_ids").alias("sum_ids"), total("t.labels").alias("sum_labels"), F.element_at("t.input_ids", -1).cast("long").alias("last_id"))


@query(f"with {TURNS}, u as (select sample_id, string_agg(coalesce(t.output, ''), chr(10) || chr(10) order by turn_no) as context from turns group by 1) select sample_id, md5(context) as context_md5 from u")
def q_context_assembly(spark, sf_dir):
    rows = C.turns(_samples(spark, sf_dir))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", F.coalesce("output", F.lit("")).alias("s")))), lambda x: x["s"]), "\n\n")
    return rows.groupBy("sample_id").agg(F.md5(joined).alias("context_md5"))


@query(f"with {TURNS} select sample_id, turn_no, md5('问题: ' || coalesce(t.input, '') || chr(10) || '证据:' || chr(10) || '' || chr(10)) as user_md5, md5({STRIP("coalesce(t.system, '')")} || chr(10) || chr(10) || {STRIP("'问题: ' || coalesce(t.input, '') || chr(10) || '证据:' || chr(10) || '' || chr(10)")} || chr(10)) as full_md5 from turns")
def q_user_prompt(spark, sf_dir):
    user = T.user_prompt(F.col("input"), F.lit(""))
    return C.turns(_samples(spark, sf_dir)).select("sample_id", "turn_no", F.md5(user).alias("user_md5"), F.md5(T.full_prompt(F.col("system"), user)).alias("full_md5"))


@query(f"with {TURNS} select sample_id, turn_no, replace(split_part(t.output, chr(10), 1), '\"', '') as first_line from turns where t.output is not null")
def q_first_line_unquoted(spark, sf_dir):
    return C.turns(_samples(spark, sf_dir)).where("output is not null").select("sample_id", "turn_no", T.first_line_unquoted(F.col("output")).alias("first_line"))


@query("select entry_key, replace(replace(replace(name, ' ', '_'), '/', '_'), chr(92), '_') as safe_name from all_aigame_prompt where name is not null")
def q_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "all_aigame_prompt").where("name is not null").select("entry_key", T.safe_filename(F.col("name")).alias("safe_name"))


@query("select line_no, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from evidence_corpus where text is not null")
def q_quote_preview(spark, sf_dir):
    return table(spark, sf_dir, "evidence_corpus").where("text is not null").select("line_no", T.preview(F.col("text")).alias("preview"))


@query("select line_no, coalesce(chunk_id, '') as chunk_id, coalesce(section, '') as section, coalesce(title, '') as title from evidence_corpus where text is not null and trim(text) <> ''")
def q_metadata_strings(spark, sf_dir):
    m = T.as_metadata
    return table(spark, sf_dir, "evidence_corpus").where("text is not null and trim(text) <> ''").select("line_no", m(F.col("chunk_id")).alias("chunk_id"), m(F.col("section")).alias("section"), m(F.col("title")).alias("title"))


@query(f"select count(*)::bigint as n_rows, count(*) filter (where doc_id is not null and text is not null and {STRIP('text')} <> '')::bigint as n_valid from evidence_corpus")
def q_valid_rows(spark, sf_dir):
    good = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (T.strip(F.col("text")) != "")
    return table(spark, sf_dir, "evidence_corpus").agg(F.count("*").alias("n_rows"), F.count_if(good).alias("n_valid"))


@query("select doc_id from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def q_not_yet_processed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select pair_id, len(list_filter(map_values(meta.feat_chosen), lambda v: v is null)) > 0 as has_empty, cardinality(meta.feat_chosen)::bigint as n_slots from preference_pairs where meta.feat_chosen is not null")
def q_slot_emptiness(spark, sf_dir):
    m = F.col("meta.feat_chosen")
    return table(spark, sf_dir, "preference_pairs").where(m.isNotNull()).select("pair_id", F.exists(F.map_values(m), lambda v: v.isNull()).alias("has_empty"), F.size(F.map_keys(m)).cast("long").alias("n_slots"))


@query("select distinct name from all_aigame_prompt where name is not null")
def q_distinct_names(spark, sf_dir):
    return table(spark, sf_dir, "all_aigame_prompt").select("name").where("name is not null").distinct()


@query("select id, array_to_string(list_transform(list_reverse_sort(list_transform(list_filter(must_quotes, lambda q: length(q) >= 3), lambda q: struct_pack(n := length(q), q := q))), lambda s: s.q), chr(10)) as ordered from eval_set where len(must_quotes) > 0")
def q_longest_first(spark, sf_dir):
    long = F.transform(F.filter("must_quotes", lambda q: F.length(q) >= 3), lambda q: F.struct(F.length(q).alias("n"), q.alias("q")))
    return table(spark, sf_dir, "eval_set").where(F.size("must_quotes") > 0).select("id", F.array_join(F.transform(F.sort_array(long, asc=False), lambda s: s["q"]), "\n").alias("ordered"))


@query("select distinct id, name from all_aigame_prompt where id is not null")
def q_catalogue_names(spark, sf_dir):
    """The names that the catalogue lists under each id, without repeats."""
    return table(spark, sf_dir, "all_aigame_prompt").where("id is not null").select("id", "name").distinct()


@query("select name, md5(arg_min(system_prompt, entry_key)) as prompt_md5, min(entry_key) as entry_key from all_aigame_prompt where name is not null and system_prompt is not null group by 1")
def q_catalogue_prompt(spark, sf_dir):
    """The system prompt of each name: its first entry in the order of the keys."""
    rows = table(spark, sf_dir, "all_aigame_prompt").where("name is not null and system_prompt is not null")
    return rows.groupBy("name").agg(F.md5(F.min_by("system_prompt", "entry_key")).alias("prompt_md5"), F.min("entry_key").alias("entry_key"))


@query("select id, count(*)::bigint as n_entries, count(distinct name)::bigint as n_names from all_aigame_prompt group by 1")
def q_catalogue_by_id(spark, sf_dir):
    """Catalogue lookup by id: null is an id of its own here, since most entries have none."""
    return table(spark, sf_dir, "all_aigame_prompt").groupBy("id").agg(F.count("*").alias("n_entries"), F.countDistinct("name").alias("n_names"))
