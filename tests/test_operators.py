import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrain.functions import picks as P
from quillgrain.operators import chunking as K
from quillgrain.operators import conversations as C
from quillgrain.operators import evidence as E
from quillgrain.operators import prompts as M
from quillgrain.operators import search as R
from quillgrain.operators import sections as S
from quillgrain.operators import web as W


def test_carry_forward(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["x", "1 T", "y", "2", "z"])], "doc_id string, line_no long, line string")
    got = [(r.line, r.section, r.title) for r in S.carry_sections(lines).orderBy("line_no").collect()]
    assert got == [("x", None, None), ("y", "1", "T"), ("z", "2", None)]


@pytest.mark.parametrize("line, n, left", [("a" * 80, 20, 0), ("a" * 80, 19, 19), ("a" * 81, 20, 20)])
def test_repeated_lines(spark, line, n, left):
    lines = spark.createDataFrame([("d", i, line) for i in range(n)], "doc_id string, line_no long, line string")
    assert S.clean_lines(lines).count() == left


@pytest.mark.parametrize("sizes, want", [([900, 1000, 499, 1400], [900, 1000, 1900]), ([900, 700, 500], [900, 1201]), ([300] * 6, [1203, 601]), ([1500, 100], [1601]), ([100], []), ([5000], [2200, 2200, 600])])
def test_section_chunks(sizes, want):
    assert [len(x) for x in K.section_chunks(["x" * n for n in sizes])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=3000), max_size=12))
def test_section_chunks_hold_their_limits(paragraphs):
    dropped = []
    chunks = list(K.section_chunks(paragraphs, dropped=dropped))
    assert all(120 <= len(c) <= 2200 for c in chunks) and all(len(d) < 120 for d in dropped)
    squeeze = lambda t: "".join(t.split())
    assert squeeze("".join(paragraphs)).count("a") == sum(squeeze(c).count("a") for c in [*chunks, *dropped])


def test_chunk_stream(spark):
    rows = [("d", s, i, "x" * n) for s, sizes in (("1", [900, 1000, 499, 1400]), ("2", [100]), (None, [300] * 6)) for i, n in enumerate(sizes)]
    got = K.chunk_sections(spark.createDataFrame(rows, "doc_id string, section string, line_no long, text string")).collect()
    assert sorted((r.section, r["index"], len(r.text), r.kept) for r in got) == [("1", 1, 900, True), ("1", 2, 1000, True), ("1", 3, 1900, True), ("2", 0, 100, False), ("UNKNOWN", 1, 1203, True), ("UNKNOWN", 2, 601, True)]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc \n", max_size=900))
def test_recursive_pieces(text):
    assert all(len(p) <= 60 for p in K.recursive_pieces(text, 60, 15))
    assert all("a" in p or "b" in p or "c" in p for p in K.recursive_pieces(text, 60, 15)) and all(p in text for p in K.recursive_pieces(text, 60, 15))
    assert {x for x in text.split() if len(x) <= 60} <= {x for p in K.recursive_pieces(text, 60, 15) for x in p.split()}


def test_structural_blocks():
    kinds = [k for _, k, _ in K.structural_blocks("# Head\n\n- item one\n> said\n```py\nx = 1\n```\n| a | b |\n\n---\nOne sentence. Two!\nno mark")]
    assert kinds == ["heading", "list", "quote", "code", "table", "rule", "sentence", "sentence", "line"]


def test_validation(spark):
    good = '{"answer": "a", "citations": [{"doc_id": "d", "section": "s", "chunk_id": "c", "quote": "q"}], "confidence": "mid", "cannot_answer_reason": null}'
    cases = {
        good: "ok", good.replace('"mid"', '"very high"'): "confidence is not low, mid or high", good.replace('"quote": "q"', '"quote": 1'): "citation without text quote", '{"answer": "a"}': "missing citations", "[1]": "not an object",
        '{"answer": "", "citations": [], "confidence": "low", "cannot_answer_reason": null}': "answerable without citations", '{"answer": "", "citations": [], "confidence": "low", "cannot_answer_reason": ""}': "ok", "{bad": "not an object",
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", E.validation_message(F.try_parse_json("j")).alias("m"))
    assert {r.j: r.m for r in df.collect()} == cases


@pytest.mark.parametrize("no, reply, ok, valid, reason, n, flags, cov, want", [
    (False, "", False, False, None, 0, [], 0.0, -10), (False, "x", False, False, None, 0, [], 0.0, -8), (False, "{}", True, True, None, 1, [True], 0.3, 10), (False, "{}", True, True, "r", 0, [], 0.0, -6), (True, "{}", True, True, "r", 0, [], 0.0, 7), (True, "{}", True, True, None, 1, [True], 0.5, -1), (True, "{}", True, True, None, 1, [False], 0.5, -6),
])
def test_scores(spark, no, reply, ok, valid, reason, n, flags, cov, want):
    df = spark.createDataFrame([(no, reply, 1 if ok else None, valid, reason, n, flags, cov)], "no boolean, reply string, obj int, valid boolean, reason string, n int, flags array<boolean>, cov double")
    assert df.select(E.candidate_score(*[F.col(x) for x in ("no", "reply", "obj", "valid", "reason", "n", "flags", "cov")])).first()[0] == want


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_key, r["rank"]): r.key for r in R.top_k(df.where("vec_id < 5"), df, "vec_id", "embedding", 4).collect()}
    for q in range(5):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        d[q] = np.inf
        assert [got[q, r + 1] for r in range(4)] == sorted(range(120), key=lambda i: (d[i], i))[:4]


def test_deterministic_draws(spark):
    ids = spark.range(50).select(F.col("id").alias("k"))
    a = P.split_first(ids, "s", 10, ["k"], "eval", "train")
    assert a.where("split = 'eval'").count() == 10
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, P.split_first(ids.repartition(7), "s", 10, ["k"], "eval", "train").collect()))


def test_conversation_rules(spark):
    conv = "conversation array<struct<system:string,input:string,output:string>>"
    df = spark.createDataFrame([("a", [("s", "i", "x" * 10), ("s", "i", "y" * 12)]), ("b", [("s", "i", "x" * 9)]), ("c", None)], f"sample_id string, {conv}")
    assert [r.sample_id for r in C.drop_short(df).where("conversation is not null").collect()] == ["a"]
    assert C.turns(df).count() == 3 and C.messages(df).count() == 6
    one = spark.createDataFrame([("祝姐姐生日", "您好姐姐，同事")], "i string, o string")
    assert one.select(C.plain_kin_output(F.col("i"), F.col("o"))).first()[0] == "你好姐，"
    assert one.select(C.occasion_input(F.col("i"), F.lit(5))).first()[0] == "祝姐姐生日快乐"


def test_token_mask(spark):
    df = spark.createDataFrame([([1, 2, 3], [8, 9])], "p array<int>, o array<int>")
    t = df.select(C.tokenize_masked(F.col("p"), F.col("o"), 4, 512).alias("t")).first()["t"]
    assert (t.input_ids, t.labels, t.attention_mask) == ([2, 3, 8, 9], [-100, -100, 8, 9], [1, 1, 1, 1])
    r = df.select(C.tokenize_right(F.col("p"), F.col("o"), 0, 5).alias("t")).first()["t"]
    assert (r.input_ids, r.labels) == ([1, 2, 3, 8, 9], [-100, -100, -100, 8, 9])


def test_unknown_role_fails(spark):
    with pytest.raises(Exception, match="unknown role"):
        C.chat_template(spark.createDataFrame([("a", 0, "robot", "x")], "k string, p int, role string, text string"), "k", "p", F.col("role"), F.col("text")).collect()


def test_web(spark):
    rows = [("q1", 0, "https://www.zhihu.com/x", "a"), ("q1", 1, "http://a/b.pdf", "b"), ("q1", 2, "http://a/c", "c"), ("q2", 0, "http://a/c", "d")]
    df = spark.createDataFrame(rows, "q string, r int, url string, s string")
    kept = W.allowed_results(df, "q", "r", "url")
    assert sorted((x.q, x.url, x.idx) for x in kept.collect()) == [("q1", "http://a/c", 0), ("q2", "http://a/c", 0)]
    assert [(x.url, x.n, x.snippets) for x in W.union_by_url(kept, "url", "q", "r", "s").collect()] == [("http://a/c", 2, "c\nd")]
    pages = spark.createDataFrame([("<p>" + "x" * n + "</p><script>no</script>",) for n in (50, 51, 2000)], "h string")
    assert sorted(len(x.content) for x in W.fetched(pages, "h").collect()) == [51, 1024]


def test_prompt_markdown(spark):
    md = "# 总\n## 敬酒\n### Prompt\n你是主人 # 注\n#### Q：你好\n#### A：请坐 # x\n#### Q：再见\n#### A：慢走\n## 送礼\n### prompt:\n你是客人\n#### Q: hi\n#### A: ho\n"
    df = spark.createDataFrame([("03-x.md", md)], "name string, text string")
    got = [(r.id, r.name, r.system_prompt.strip(), [(e.input.strip(), e.output.strip()) for e in r.example]) for r in M.catalogue_records(df.withColumn("text", F.regexp_replace("text", "^# 总\n", "")), "name", "text").collect()]
    assert got == [(3, "敬酒", "你是主人", [("你好", "请坐"), ("再见", "慢走")]), (3, "送礼", "你是客人", [("hi", "ho")])]
    check = df.select(M.template_check(F.col("text")).alias("c")).first()["c"]
    assert check.ok and not spark.createDataFrame([("### Prompt",)], "x string").select(M.template_check(F.col("x"))["ok"]).first()[0]


def test_catalogue_lookups(spark):
    scenes = spark.createDataFrame([("4：送祝福", ["年龄"]), ("2：送礼", ["对象"])], "type string, attributes array<string>")
    assert M.scene_by_label(scenes, "4").first().type == "4：送祝福"
    row = spark.createDataFrame([(["a", "b"], {"a": "x"}, '["p", "q"]')], "at array<string>, d map<string,string>, l string")
    r = row.select(M.describe(F.col("at"), F.col("d")).alias("m"), M.empty_slots(F.col("at")).alias("e"), M.literal_list(F.col("l")).alias("l"), M.is_known_label(F.array(F.lit("4：x")), F.lit("4")).alias("k")).first()
    assert r.m == {"a": "x", "b": None} and r.e == {"a": "", "b": ""} and r.l == ["p", "q"] and r.k
    assert spark.createDataFrame([({"t": "s"},)], "m map<string,string>").select(*M.first_entry(F.col("m"))).first()[:] == ("t", "s")


def test_targets_and_report(spark):
    from quillgrain.operators import builders as D
    from quillgrain.operators import metrics as N

    assert D.instruction_targets() == {"refusals": 1625, "answerables": 4875, "anchors": 1706, "anchor_refusals": 406}
    assert D.eval_targets() == {"unanswerable": 79, "answerable": 161}
    rows = [("base", True, True, 2, 1, 0.3, True, "answerable", False), ("base", True, True, 3, 3, 0.1, True, "answerable", False)]
    judged = spark.createDataFrame(rows, "field string, parsed_ok boolean, valid boolean, n_citations int, n_exact int, covered double, first_exact boolean, kind string, refused boolean")
    m = N.metrics(judged, "field").first()
    assert (m.citation_rate, m.grounded_rate, m.refusal_rate) == (0.8, 0.5, 0.0)
    report = N.report_markdown(N.compare(N.metrics(judged, "field"), "base", "base"))
    assert "| citation_rate | 80.0% | 80.0% | flat |" in report


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 0.05 + np.eye(3)[i % 3] * 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert R.best_k(df, "vec_id", "embedding", 2, 4) == 3
    v = R.embed_texts(spark.createDataFrame([("b a a",)], "t string"), "t", R.hashed_vectors(8)).first()["embedding"]
    assert sum(v) == 3 and len(v) == 8


def test_assembling_helpers(spark):
    from quillgrain.operators import builders, search
    from quillgrain.sources import files

    assert builders.instruction_targets(14, 0)["refusals"] == 4  # halves round to even, as the source tools do
    df = spark.range(5)
    assert builders.require_rows(df, 5).count() == 5
    with pytest.raises(ValueError):
        builders.require_rows(df, 6)
    urls = spark.createDataFrame([("a",), ("b",), ("b",), ("bad",), (None,)], "url string")

    def fetch(u):
        if u == "bad":
            raise OSError(u)
        return u * 2

    got = files.fetch_missing(urls, spark.createDataFrame([("a",)], "url string"), "url", fetch)
    assert {tuple(r) for r in got.collect()} == {("b", "bb"), ("bad", None), (None, None)}
    rows = spark.createDataFrame([(i, [float(i // 10) * 9 + (i % 10) / 10, 1.0]) for i in range(30)], "vec_id long, v array<double>")
    assert search.best_k(rows, "vec_id", "v", 2, 5) == 3
    assert search.embed_texts(spark.createDataFrame([(1, "a a b"), (2, None)], "i int, t string"), "t", search.hashed_vectors(4)).where("embedding is null").count() == 1
