import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrain.llm import common, defects, endings, leaks, packing, repetition, splitting, toxicity, truncation


def test_normalise_and_answers():
    assert common.normalise("Ａb-1 中，\n") == "ab1中" and common.normalise(None) == ""
    assert common.answer_text('ok\n```json\n{"answer": "x"}\n```') == "x"
    assert common.answer_text('{"answer": "x",}') == '{"answer": "x",}' and common.answer_text(None) == ""
    assert common.question_of("sys\n\nQuestion: why?\nEvidence:\n[chunk_id=C1 doc_id=d]") == "why?" and common.chunk_of("[chunk_id=C1 doc_id=d]") == "C1"
    assert common.question_of("just ask") == "just ask" and common.question_of(None) == ""


def brute_share(text):
    n = common.normalise(text)
    total = len(n) - 9
    return len(n) >= 100 and total - len({n[i : i + 10] for i in range(total)}) >= 0.3 * total - 1e-9


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["abc def. ", "礼尚往来。", "one two three four\n", "x", "沉默是金！", "qwertyuiop"]), max_size=60), st.permutations(list(repetition.RULES)))
def test_repetition_in_any_rule_order(parts, order):
    text = "".join(parts)
    norm = common.normalise(text)
    said = [r for r in (repetition.RULES[n](text, norm, 10, 0.3, 100) for n in [*order, "windows"]) if r is not None]
    assert all(s == brute_share(text) for s in said)


def test_repetition_rows(spark):
    loop = "thank you " * 30
    rows = [("a", loop, 1), ("a", loop, 1), ("b", None, 2), ("c", "", 3), ("d", "plain words here", 4), ("e", "z" * 9000, 5)]
    df = spark.createDataFrame(rows, "k string, body string, k0 int")  # names that the operator uses itself
    assert sorted(r.k for r in repetition.repetitive_texts(df, ["k"], "body").collect()) == ["a", "a", "e"]
    assert repetition.repetitive_texts(df.limit(0), ["k"], "body").count() == 0
    shares = {r.k: r.window_share for r in repetition.repetition_shares(df, ["k"], "body").collect()}
    assert shares["b"] == shares["c"] == 0 and shares["a"] > 0.9


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab,. \n。", max_size=600), st.integers(20, 80), st.integers(0, 12))
def test_split_round_trip(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    body = text.strip()
    assert "".join(body[own:end] for _, own, end, _ in pieces) == body
    assert all(0 < end - start <= limit for start, _, end, _ in pieces)
    if splitting.longest_run(body) <= limit - overlap - 1:
        assert all(own - start == overlap for start, own, _, _ in pieces[1:] if own >= overlap)
    if splitting.longest_run(body) < limit - overlap:
        assert all(kind != "forced" for *_, kind in pieces)


def test_split_rows(spark):
    rows = [(1, None, "S"), (2, "", "S"), (3, "x" * 2201, None), (4, " " + "word " * 900, "S"), (4, " " + "word " * 900, "S"), (5, "y" * 2200 + "  ", "S")]
    df = spark.createDataFrame(rows, "line_no long, text string, k string")
    out = splitting.split_oversized(df.withColumn("section", F.lit("A")), "line_no", "text", "section").collect()
    assert {(r.line_no, r.boundary) for r in out} == {(3, "forced"), (4, "natural")}
    assert max(len(r.piece) for r in out) <= 2200 and sum(r.line_no == 4 and r.piece_no == 1 for r in out) == 2


def test_leaks_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh中文字") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(90, None), (91, "short")]
    docs = []
    for d in range(60):
        base = " ".join(word() for _ in range(40))
        if d % 3 == 0:
            src = items[d % 6][1]
            a = rng.randint(0, 40)
            base = base[:50] + src[a : a + rng.randint(30, 70)].upper() + base[50:]
        docs.append((d, base))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    got = sorted((r.doc_id, r.item_id, r.n_chars) for r in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect())

    def longest(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    new[j + 1] = row[j] + 1
            row, best = new, max(best, max(new))
        return best

    want = sorted((d, i, n) for d, t in docs for i, s in items if (n := longest(common.normalise(t), common.normalise(s))) >= 40)
    assert got == want and len(want) > 8
    empty = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text")
    assert empty.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1))
def test_patterns_cover_all_sizes(counts):
    plan = packing.plan_patterns(counts, (16, 32, 64))
    used = {}
    for use, length, times in plan:
        assert times > 0 and sum(s * k for s, k in use) <= length
        for s, k in use:
            used[s] = used.get(s, 0) + k * times
    assert used == counts
    total = sum(s * c for s, c in counts.items())
    assert sum(length * times for _, length, times in plan) <= 2 * total + 64


def test_pack_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 100)) for i in range(400)] + [(1000, 5000), (1001, 0), (1002, None), (7, 50)] + [(2000 + i, 33) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "k long, n long").withColumn("s", F.lit("clash")), "k", "n", 128, (32, 64, 128)).toPandas()
    assert out.groupby("k").n_tokens.sum()[1000] == 5000 and len(out[out.k == 1000]) == 40 and set(out[out.container_id.isna()].k) == {1001, 1002}
    boxes = out.dropna().groupby("container_id").agg(s=("n_tokens", "sum"), cap=("container_length", "max"))
    assert (boxes.s <= boxes.cap).all() and boxes.s.sum() / boxes.cap.sum() > 0.93
    assert packing.pack(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0


def test_tokens(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r.k: r.n_tokens for r in packing.count_tokens(spark.createDataFrame([(1, "hello hello"), (2, None), (3, "<|endoftext|>")], "k long, t string"), "k", "t", path).collect()}
    assert got[2] == 0 and got[1] == 2 and got[3] > 1


def test_final_marks():
    e = endings.final_mark
    assert e("完了。") == e("Done! 🎉") == e("谢谢（完）") == e("") == endings.CLOSED
    assert e("ends \ufffd") == e("停在这…") == endings.BROKEN and e("so it is done!…") == endings.CLOSED
    assert e("First done. The second one is def") == e("要点：\n- 索引映射") == endings.OPEN
    assert endings.Reply('{"answer": "x. y').broken_object and endings.Reply('{"answer": "x.",}').state == endings.CLOSED


def values_with_open_ends(seed, n=1500, limit=90):
    """(text, is cut): prose, some of it cut at a limit or anywhere, and kinds that are whole without a mark."""
    rng = random.Random(seed)
    nouns, verbs = ["阀门", "水箱", "灯", "闸口", "管道", "仪表"], ["打开", "关闭", "检查", "记录", "擦净"]
    wishes = ["平安喜乐", "前程似锦", "花好月圆", "万事如意", "步步高升", "阖家安康"]
    sentence = lambda: f"{rng.choice(['先', '再', '随后', '最后'])}{rng.choice(verbs)}{rng.choice(nouns)}，{rng.choice(['等', '过'])}{rng.randint(2, 90)}秒再{rng.choice(verbs)}{rng.choice(nouns)}。"
    out = []
    for _ in range(n):
        kind, text = rng.random(), "".join(sentence() for _ in range(rng.randint(2, 9)))
        if kind < 0.08:
            out.append((text[: rng.randrange(8, len(text))], True))
        elif kind < 0.3:
            out.append((text[:limit], len(text) > limit))
        elif kind < 0.4:
            out.append(("要点：" + "".join(f"\n- {rng.choice(verbs)}{rng.choice(nouns)}" for _ in range(rng.randint(2, 4))), False))
        elif kind < 0.5:
            out.append(("祝您" + "，".join(rng.sample(wishes, rng.randint(2, 4))), False))
        elif kind < 0.55:
            out.append((f"See part {rng.randint(1, 9)}.{rng.randint(1, 9)}", False))
        elif kind < 0.6:
            out.append((text + rng.choice(["谢谢", "完", "急，在线等"]), False))
        else:
            out.append((text, False))
    return [(t, cut and endings.final_mark(t) == endings.OPEN) for t, cut in out]


def test_endings_are_learned(spark):
    """Held-out precision and recall of limits and of the learned endings."""
    rows = [(f"r{i}", "s", t, c) for i, (t, c) in enumerate(values_with_open_ends(5))]
    df = spark.createDataFrame([r[:3] for r in rows], "k string, source string, text string").repartition(3)
    measured = truncation.measure(df, ["k", "source"], "text")
    found = {r.k: r for r in truncation.cut_values(measured, ["source"], ["k"]).collect()}
    want = {k for k, _, _, c in rows if c}
    at_limit = {k for k, r in found.items() if r.limit_unit}
    assert at_limit <= want and 0.5 < len(at_limit) / len(want) < 0.95
    right = len(set(found) & want)
    assert right / len(want) > 0.92 and right / len(found) > 0.97  # 1500 rows teach less than the real tables
    model = truncation.ending_model(measured, ["source"])
    fresh = [(t, c) for t, c in values_with_open_ends(77, 600) if endings.final_mark(t) == endings.OPEN]
    said = [(model.cut(t) > 0, c) for t, c in fresh]
    assert sum(a == b for a, b in said) / len(said) > 0.95


def test_a_limit_of_sixty(spark):
    rng = random.Random(3)
    rows = [(f"w{i}", " ".join("word" for _ in range(rng.randint(2, 11))) + ".") for i in range(200)] + [(f"c{i}", ("some words and more of the same kind. " * 4)[i : i + 59] + "w") for i in range(12)]
    df = spark.createDataFrame(rows, "k string, text string").withColumn("source", F.lit(None).cast("string"))
    limits = truncation.length_limits(truncation.measure(df, ["k", "source"], "text"), ["source"]).collect()
    assert {(r.unit, r.length) for r in limits} == {("chars", 60), ("bytes", 60)}


QUESTION = "请说明两盏灯之间的关系。"


@pytest.fixture(scope="module")
def tagger():
    none = np.empty((0, endings.WIDTH), dtype=np.int64)
    odds = endings.fit_endings(none, np.empty(0, dtype=np.int64), np.empty(0, dtype=bool), none).cut
    return defects.Field().fit(*defects.training_sequences([], odds)), odds


@pytest.mark.parametrize("reply, may, want", [
    (None, False, "empty"), ("  ", False, "empty"), ("N/A", False, "empty"), ("```\n```", False, "empty"), ("{}", False, "empty"), ('{"answer": " ", "citations": [], "cannot_answer_reason": null}', False, "empty"),
    ("抱歉，我无法回答这个问题。", False, "refusal"), ("抱歉，我无法回答这个问题。", True, None), ('{"answer": "", "citations": [], "cannot_answer_reason": "证据不足。"}', False, "refusal"), ('{"answer": "", "cannot_answer_reason": "证据不足。"}', True, None),
    ("答：" + QUESTION, False, "copied"), ("请说明两盏灯之间的关系", False, "copied"), (QUESTION + "\n左灯先亮。右灯后亮，间隔为三秒。", False, None),
    ("The left lamp lights up first. The right one follows.", False, "language"), ("左灯先亮。右灯在三", False, "truncated"), ('{"answer": "左灯先亮。右灯', False, "truncated"), ("左灯先亮。右灯后亮。", False, None), ("不需要。", False, None),
])
def test_defects(tagger, reply, may, want):
    assert defects.reply_defect(reply, QUESTION, may, *tagger) == want


def test_requested_language_is_no_defect(tagger):
    assert defects.reply_defect("The left lamp lights up first.", "请用英文回答：" + QUESTION, False, *tagger) is None
    assert defects.reply_defect("Nadie espera una nota breve, pero siempre se agradece.", "How are the two lamps related?", False, *tagger) == "language"


def test_field_learns_transitions():
    """Decoding against enumeration on a tiny field, and the likelihood's gradient against differences."""
    import itertools

    field = defects.Field()
    rng = np.random.default_rng(0)
    field.move[:] = rng.normal(size=field.move.shape)
    scores = rng.normal(size=(3, len(defects.TAGS)))
    best = max(itertools.product(range(5), repeat=3), key=lambda t: sum(s[x] for s, x in zip(scores, t)) + sum(field.move[a, b] for a, b in zip(t, t[1:])))
    assert tuple(defects._viterbi(scores, field.move)) == best
    # one step from zero: every tag is as likely as any other, so the gradient is known
    seqs = [defects.Sequence(endings.Reply(t), QUESTION, lambda x: 0.0) for t in ("左灯先亮。右灯后亮。再说一句。", "左灯先亮。")]
    tags = [[defects.ANSWER, defects.REFUSAL, defects.REFUSAL], [defects.ANSWER]]
    one = defects.Field().fit(seqs, tags, steps=1)
    assert np.allclose(one.move, np.where(_moves(tags) - 2 / 25 > 0, 0.15, -0.15)) and one.emit[defects.F_FIRST, defects.ANSWER] > 0 > one.emit[defects.F_FIRST, defects.REFUSAL]


def _moves(tags):
    out = np.zeros((5, 5))
    for t in tags:
        for a, b in zip(t, t[1:]):
            out[a, b] += 1
    return out


def test_the_field_beats_rules_on_refusals_it_never_saw(spark):
    """Ways to decline are mined from the rows that may decline: no list holds this one."""
    rng = random.Random(8)
    say = lambda: f"{rng.choice(['左', '右', '前', '后'])}灯在{rng.randint(1, 60)}秒后{rng.choice(['亮', '灭'])}。{rng.choice(['然后停止', '随后等待', '最后记录'])}。"
    no = "此类咨询请另寻他处。"
    rows = [(f"a{i}", f"{rng.choice(['左', '右'])}灯在第{i}步怎样动作？", say(), False) for i in range(300)]
    rows += [(f"m{i}", f"右灯在第{i}步怎样动作？", no if i % 2 else say(), True) for i in range(120)] + [(f"n{i}", f"前灯在第{i}步怎样动作？", no, False) for i in range(6)]
    df = spark.createDataFrame(rows, "row_key string, prompt string, reply string, may_refuse boolean")
    got = {r.row_key: r.defect for r in defects.broken_replies(df, ["row_key"], "prompt", "reply", "may_refuse").collect()}
    assert got == {f"n{i}": "refusal" for i in range(6)}


def test_empty_objects_and_long_replies(tagger):
    assert defects.reply_defect('{"answer": "see items [a,] and b.", "citations": []}', "Which items?", False, *tagger) is None
    long = "左灯先亮，右灯在三秒之后亮。" * 250
    assert defects.reply_defect(long, QUESTION, False, *tagger) is None
    assert defects.reply_defect(long + "然后再看左", QUESTION, False, *tagger) == "truncated"


def test_defect_rows(spark):
    rows = [("1", QUESTION, None, False), ("2", None, "好的。", False), ("3", QUESTION, "抱歉，我无法回答这个问题。", None), ("3", QUESTION, "抱歉，我无法回答这个问题。", None), ("4", QUESTION, "长" * 20000 + "。", False)]
    df = spark.createDataFrame(rows, "row_key string, prompt string, reply string, may_refuse boolean").withColumn("defect", F.lit("clash"))
    got = sorted((r.row_key, r.defect) for r in defects.broken_replies(df, ["row_key"], "prompt", "reply", "may_refuse").collect())
    assert got == [("1", "empty"), ("3", "refusal"), ("3", "refusal")]
    assert defects.broken_replies(df.limit(0), ["row_key"], "prompt", "reply", "may_refuse").count() == 0


def test_limits(spark):
    rng = random.Random(2)
    sentence = lambda n: " ".join("word" for _ in range(n // 5)) + "."
    rows = [(f"w{i}", "s", sentence(rng.randint(50, 900))) for i in range(300)]
    rows += [(f"c{i}", "s", ("one two three. " * 60)[:401] + "xyz"[: i % 1]) for i in range(30)] + [("n", None, None), ("b", None, "  ")]
    df = spark.createDataFrame(rows, "k string, source string, text string")
    measured = truncation.measure(df, ["k", "source"], "text")
    assert [(r.unit, r.length) for r in truncation.length_limits(measured, ["source"]).orderBy("unit").collect()] == [("bytes", 401), ("chars", 401)]
    assert sorted(r.k for r in truncation.cut_values(measured, ["source"], ["k"]).collect()) == sorted(f"c{i}" for i in range(30))


def test_toxicity_learns(spark):
    mild = ["He walked to the market and bought a hat.", "The manual says never to call a guest an idiot.", "We sat down and ate noodles.", "她把请帖放在桌上。", "饭后大家散步。"]
    bad = ["Get lost, you idiot, nobody wants you.", "You stupid bitch, crawl back.", "你这个废物，滚蛋吧。", "I will kill you, you bastard."]
    rng = random.Random(4)
    text = lambda extra=(): " ".join(rng.sample([*rng.choices(mild, k=6), *extra], 6 + len(extra)))
    docs = [(i, text([rng.choice(bad)] if i % 5 == 0 else ())) for i in range(300)] + [(900, None), (901, "")]
    labels = [(i, 1 if i % 5 == 0 else 0) for i in range(200)] + [(3, None), (4, 1)]
    out = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(1)), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text")
    got = {r.doc_id: r.abusive for r in out.collect()}
    held = [(got[i], i % 5 == 0) for i in range(200, 300)]
    assert sum(a == b for a, b in held) >= 98 and not got[900] and not got[901]
    none = toxicity.score_documents(spark.createDataFrame(docs[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text")
    assert none.count() == 3


def test_a_cut_inside_a_word_that_looks_like_a_farewell(tagger):
    assert defects.reply_defect("左灯先亮。流程从续约命令开始，到合并完", QUESTION, False, *tagger) == "truncated"


@pytest.mark.parametrize("n", [5, 60, 180, 300])
def test_a_clause_is_read_alike_in_replies_of_any_size(tagger, n):
    own, foreign = "左灯先亮，右灯在三秒之后亮，然后两盏灯一起亮，最后一起熄灭。", "The left lamp lights up first, and the right one follows. "
    seq = defects.Sequence(endings.Reply((own + foreign) * n), QUESTION, tagger[1])
    assert seq.letters == [len(common.normalise(own)), len(common.normalise(foreign))] * n
    assert seq.foreign == [False, True] * n
    assert defects.reply_defect(own * n + foreign * 2 * n, QUESTION, False, *tagger) == "language"


def test_only_the_piece_of_a_long_run_gives_up_overlap():
    sentence = "本段说明两盏灯之间的先后次序，以及相隔的秒数。"
    before = sentence * 700
    text = before + "x" * 2150 + "。" + sentence * 700
    pieces = splitting.split_text(text)
    less = [(own, own - start) for start, own, *_ in pieces[1:] if own - start < 200]
    assert less == [(len(before), 2200 - 2151)]
    assert all(kind != "forced" for *_, kind in pieces) and all(end - start <= 2200 for start, _, end, _ in pieces)
    # a longer run elsewhere in the row, which is cut by force, costs this one nothing
    pieces = splitting.split_text(text + "y" * 5000 + "。")
    assert any(text[own:end] == "x" * 2150 + "。" for _, own, end, _ in pieces)


def test_short_lines_are_scored():
    tables, model = toxicity._tables(), toxicity.ToxicChain()
    model.weights[np.unique(toxicity.Sentences(["傻逼"], tables).cols), -1], model.bias[-1] = 20.0, -1.0  # what a fit may learn
    texts = ["他走到市场买了一顶帽子。\n傻逼！\n饭后大家散步。", "他走到市场买了一顶帽子。\n好的！\n饭后大家散步。", "傻逼！", "12\n!"]
    p, doc = model.score(texts, tables)
    top = np.zeros(len(texts) + 1)
    np.maximum.at(top, doc, p[:, -1])
    assert top[0] > 0.6 > top[1] and top[2] > 0.6 and top[3] == 0


def test_short_sentences_stay_in_their_text():
    cp, sent, doc = toxicity._stream(["好的事情很多。傻逼！\n后来他走了。", "滚！他来了很久。", "去死!", None])
    parts = ["".join(map(chr, cp[sent == i])).strip("\x00 \n") for i in range(len(doc))]
    assert [(d, x) for d, x in zip(doc, parts) if x] == [(0, "好的事情很多。傻逼!"), (0, "后来他走了。"), (1, "滚!他来了很久。"), (2, "去死!")]


def test_negatives_come_from_all_clean_documents(monkeypatch):
    seen = []
    real = toxicity.Sentences
    monkeypatch.setattr(toxicity, "Sentences", lambda texts, tables: seen.append(list(texts)) or real(texts, tables))
    clean = [f"document {i} has a plain line of words." for i in range(500)]
    toxicity.fit_chain([["Get lost, you idiot."]], clean, negatives=10)
    used = {int(s.split()[1]) for texts in seen[2:] for s in texts if s.startswith("document") and len(texts) > 1}
    assert max(used) > 400
    assert toxicity._highest([(0.2, "a"), (0.9, "b"), (0.5, "c")], 2) == ["b", "c"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.sampled_from([". ", "。", " ", "\n\n", "!!!!", ".”)", ";  "])), min_size=1, max_size=14), st.integers(0, 6))
def test_the_label_of_a_row_follows_from_its_cuts(parts, overlap):
    body = "".join("x" * n + mark for n, mark in parts).strip()
    pieces = splitting.split_text(body, 30, overlap)
    assert "".join(body[own:end] for _, own, end, _ in pieces) == body and all(end - start <= 30 for start, _, end, _ in pieces)
    assert any(splitting.run_around(body, end) > 30 for *_, end, _ in pieces[:-1]) == (splitting.longest_run(body) > 30)


def test_a_comma_before_a_bracket_inside_a_sound_object():
    reply = endings.Reply('{"answer": "see items [a,] and b.", "citations": []}')
    assert reply.found["answer"] == "see items [a,] and b." and reply.state == endings.CLOSED
    assert endings.Reply("no object, but [a,] list").found is None


def test_leaks_in_rounds_over_stored_arrays(spark, monkeypatch):
    text = lambda n: "".join(random.Random(n).choices("abcdefgh中文字", k=80))
    items = [(i, text(i)) for i in range(4)]
    docs = [(d, text(900 + d) + text(d % 4)[10:70] + text(500 + d)) for d in range(12)] + [(77, None)]
    frames = lambda: (spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    find = lambda: sorted(tuple(r) for r in leaks.leaked_items(frames()[0], "doc_id", "text", frames()[1], "item_id", "text").collect())
    once = find()
    monkeypatch.setattr(leaks, "ITEM_CHARS", 170)
    assert find() == once == [(d, d % 4, 60, 80, 10) for d in range(12)]


@pytest.mark.parametrize("hits", [leaks.HITS, 50])
def test_matches_of_repeating_texts(monkeypatch, hits):
    monkeypatch.setattr(leaks, "HITS", hits)
    texts, items = ["ab" * 90 + "x" + "ab" * 30, "a" * 300, "q" * 60], ["ba" * 70, "a" * 200]
    best = leaks.longest_matches(texts, leaks.suffix_order(texts, 25, 16), items, leaks.suffix_order(items, 25), 40, 16)
    assert {k: v[0] for k, v in best.items()} == {(0, 0): 140, (1, 1): 200}
    assert best[0, 0][1:] == (-1, 0)


def test_pack_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rows = [("same", 33)] * 100 + [(f"d{i}", 128 * (i % 3) + i % 5) for i in range(200)]
    out = packing.pack(spark.createDataFrame(rows, "k string, n long").repartition(3), "k", "n", 128, (32, 64, 128)).toPandas()
    assert out.n_tokens.sum() == sum(n for _, n in rows) and (out.groupby("k").n_tokens.sum()["same"] == 3300)
    boxes = out.dropna().groupby("container_id").agg(s=("n_tokens", "sum"), cap=("container_length", "max"), n=("n_tokens", "size"))
    assert (boxes.s <= boxes.cap).all() and (boxes.n[boxes.s == 128] >= 1).all() and boxes.s.sum() / boxes.cap.sum() > 0.85
    alone = out[out.n_tokens == 128]
    assert alone.container_id.is_unique and not set(alone.container_id) & set(out[out.n_tokens < 128].container_id.dropna())
