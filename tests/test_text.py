import pytest
from pyspark.sql import functions as F

from quillgrain.functions import text as T
from quillgrain.functions import vectors as V

c = F.col


@pytest.mark.parametrize("line, section, title", [
    ("5.4.3.2 Registration", "5.4.3.2", "Registration"), ("Annex L Foo", "Annex L", "Foo"), ("K.2.2.5", "K.2.2.5", None), ("5.4.3a x", "5.4", ".3a x"), ("3GPP scope", None, None), ("12 items are", "12", "items are"), ("Annex Lambda", None, None),
])
def test_heading(value, line, section, title):
    a, b = T.heading(c("x"))
    assert (value(a, "x string", line), value(b, "x string", line)) == (section, title)


def test_line_rules(value):
    assert value(T.normalize_line(c("x")), "x string", "A  b\tc ") == "A b c"
    for line, want in (("17", True), ("Page 3 of 9", True), ("page 4", True), ("Page x", False)):
        assert value(T.is_page_number(c("x")), "x string", line) is want
    for line, want in (("a|b|c|d", True), ("a|b|c", False), ("x ─ y", True), ("", True)):
        assert value(T.is_table_noise(c("x")), "x string", line) is want
    for line, want in (("Annex L (normative): ... 717", True), ("see clause 5", True), ("Release 18.", False)):
        assert value(T.is_toc_like(c("x")), "x string", line) is want


def test_names(value):
    f = T.chunk_id(c("d"), c("s"), c("i"))
    assert value(f, "d string, s string, i int", "23501-k00", "Annex A", 3) == "23501K00-AnnexA-0003"
    assert value(f, "d string, s string, i int", "", None, 12) == "DOC-UNKNOWN-0012"
    assert value(T.file_stem(c("x")), "x string", "/a/b.c/name.tar.gz") == "name.tar"
    assert value(T.safe_filename(c("x")), "x string", "a b/c\\d") == "a_b_c_d"
    assert value(T.catalogue_number(c("x")), "x string", "03-敬酒.md") == 3
    assert value(T.catalogue_number(c("x")), "x string", "ab.md") is None


def test_sentences_and_quotes(value):
    assert value(T.sentences(c("x")), "x string", "A one. B two? c: d;e") == ["A one.", "B two?", "c:", "d;e"]
    assert value(T.quote_candidates(c("x")), "x string", f"{'a' * 70}. {'b' * 40}.") == ["a" * 70 + "."]
    assert value(T.quote_candidates(c("x")), "x string", f"{'b' * 40}. short.") == ["b" * 40 + "."]
    assert value(T.shorten(c("x")), "x string", "a" * 119 + " b") == "a" * 119 + "..."
    assert value(T.preview(c("x")), "x string", "a" * 201) == "a" * 200 + "..."
    assert value(T.bullets(c("x")), "x string", "a\n\n b \nc") == "- a\n- b\n- c"


def test_coverage(value):
    f = T.coverage(c("a"), c("e"))
    assert value(f, "a string, e string", "the amf selects smf", "when the amf selects smf for pdu") == 1.0
    assert value(f, "a string, e string", "a b", "a b c d") == 0.0


def test_transcript(value):
    assert value(T.clean_transcript(c("x")), "x string", "[0,00:12] < No Speech >你好 世界 。\nabc , def") == "你好,世界, abc,def"


def test_scrubs(value):
    assert value(T.scrub_qa_json(c("x")), "x string", '```json\n[{"a": "json"}]\n```') == '[{"a":"json"}]'
    assert value(T.scrub_literal(c("x")), "x string", "```python\n[“a”，“b”]\n```") == '["a","b"]'
    assert value(T.first_line_unquoted(c("x")), "x string", '"a" b\nc') == "a b"
    assert value(T.json_escape(c("x")), "x string", 'a"b\n') == 'a\\"b\\n'
    assert value(T.wish_label(c("n"), c("s"), c("t")), "n string, s string, t string", "姐姐", "生日", "正常") == "祝姐姐生日"
    assert value(T.wish_label(c("n"), c("s"), c("t")), "n string, s string, t string", "姐姐", "生日", "小红书") == "祝姐姐生日,小红书风格"


def test_brace_object(value):
    f = T.brace_object(c("x"))
    assert value(f, "x string", 'hi {"a": {"b": 1}} tail}') == '{"a": {"b": 1}}'
    assert value(f, "x string", "none") == ""
    assert value(f, "x string", '{"a": "{"} x') == ""  # braces in quotes count, too
    assert value(f, "x string", "{open") == ""


def test_marks_and_formats(value):
    assert value(T.mark_quotes(c("t"), c("q")), "t string, q array<string>", "The (AMF) selects.", ["no", "(amf)"]) == "The <mark>(AMF)</mark> selects."
    assert value(T.metric_text(c("x")), "x double", 0.5) == "50.0%"
    assert value(T.metric_text(c("x")), "x double", 2.0) == "2.00"
    assert value(T.metric_text(c("x")), "x double", None) == "N/A"
    assert value(T.flag_text(c("x")), "x boolean", True) == "✅"
    assert value(T.trend(c("a"), c("b")), "a double, b double", 1.0, 1.2) == "up"
    assert value(T.trend(c("a"), c("b")), "a double, b double", 0.0, 1.2) == ""
    assert value(T.first_heading_level(c("x")), "x string", "text\n## b\n# c") == "##"


def test_vectors(value):
    assert value(V.unit(c("x")), "x array<double>", [3.0, 4.0]) == [0.6, 0.8]
    assert value(V.cosine(c("x"), c("x")), "x array<double>", [0.0, 0.0]) is None
    assert value(V.l2(c("x"), c("y")), "x array<double>, y array<double>", [0.0, 3.0], [4.0, 0.0]) == 5.0
