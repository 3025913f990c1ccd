import io
import zipfile

from pyspark.sql import functions as F

from quillgrain.session import write_shared
from quillgrain.sources import files as A
from quillgrain.sources import sinks as B
from quillgrain.streaming import log as L

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("One  two", "", "Three"))
    (tmp_path / "b.fb2").write_text("<FictionBook><body><p>Hello</p><p>there</p></body></FictionBook>")
    (tmp_path / "c.md").write_text("# x")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.rtf").write_bytes(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hi\par there}")
    got = {r.file.rpartition("/")[2]: (r.text, r.error) for r in A.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"][0] == "One  two\nThree" and got["b.fb2"][0] == "Hello\nthere" and got["c.md"][0] == "# x"
    assert got["d.pdf"] == (None, "unsupported") and got["e.docx"][0] is None and got["e.docx"][1]
    assert "Hi" in got["f.rtf"][0] and "Arial" not in got["f.rtf"][0]
    (tmp_path / "e.docx").unlink()
    assert [(r.doc_id, r.line) for r in A.read_docx_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [("a", "One two"), ("a", "Three")]
    assert A.manifest(spark, str(tmp_path), "*.md").first().n_bytes == 3


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/a.docx", docx("x"))
        z.writestr("b.txt", "no")
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("b.txt", "no")
    got = sorted((r.name, r.error) for r in A.unzip(spark, str(tmp_path)).collect() if r.name) + [r.error for r in A.unzip(spark, str(tmp_path)).collect() if r.error]
    assert got == [("a.docx", None), "no document inside"]


def test_json_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "中", None), (2, "b", "x")], "a int, b string, c string")
    B.write_jsonl(df, f"{tmp_path}/l")
    B.write_jsonl(df, f"{tmp_path}/l", append=True)
    assert B.count_lines(spark, f"{tmp_path}/l") == 4
    assert A.read_jsonl(spark, f"{tmp_path}/l", "a int, b string, c string").distinct().count() == 2
    (tmp_path / "arr.json").write_text(B.json_document(df))
    assert A.read_json_array(spark, f"{tmp_path}/arr.json", "a int, b string, c string").count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text('[{"t": "s"}, {"u": "v"}]')
    (tmp_path / "j/2.json").write_text('{"t": "s"}')
    (tmp_path / "j/3.json").write_text('{"t": "s"} junk {"u": "v"} {bad}')
    n = {r[0][-6:]: r[1] for r in A.read_json_lenient(spark, f"{tmp_path}/j").groupBy("file").count().collect()}
    assert n == {"1.json": 2, "2.json": 1, "3.json": 2}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, g string, ok boolean")
    B.write_partitioned(df, f"{tmp_path}/p", "g")
    assert spark.read.json(f"{tmp_path}/p").where("g = 'a'").count() == 1
    B.split_outputs(df, "ok", f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/part=rejected").first().k == 2
    B.write_csv(df, f"{tmp_path}/c")
    assert A.read_csv(spark, f"{tmp_path}/c").count() == 2
    B.save_index(df, f"{tmp_path}/i")
    assert B.save_index(df.limit(1), f"{tmp_path}/i").count() == 2 and B.save_index(df.where("k = 1"), f"{tmp_path}/i", "overwrite").count() == 1
    one = spark.createDataFrame([({"t": "s"},)], "m map<string,string>")
    assert one.select(B.entry_text(F.col("m"))).first()[0] == "t: s\n\n"
    assert A.not_done(df, df.where("k = 1"), "k").first().k == 2 and write_shared(df).count() == 2


def test_outside_calls(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string")

    def call(x):
        if x == "bad":
            raise ValueError
        return x.upper()

    assert [r[0] for r in df.select(A.outside_column(call)("t")).collect()] == ["A", None, None]
    assert [r.result for r in A.in_batches(df.where("t is not null"), "t", lambda xs: [x + "!" for x in xs], 1).collect()] == ["a!", "bad!"]
    page = '<div class="bili-video-card"><a href="//v/1"></a><h3>A <b>t</b></h3><span class="view">12</span></div>'
    card = spark.createDataFrame([(page,)], "h string").select(A.video_cards(F.col("h"))).first()[0][0]
    assert (card.url, card.title, card.views) == ("//v/1", "A t", "12")


def test_stream_twice_counts_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", True), (1, "2024-01-01 00:00:00", "a", True), (2, "2024-01-01 05:00:00", "a", None)]
    df = spark.createDataFrame(rows, "log_id long, t string, model_type string, json_valid boolean").select("log_id", F.col("t").cast("timestamp").alias("logged_at"), "model_type", "json_valid")
    df.write.parquet(f"{tmp_path}/in")
    calls = L.read_calls(spark, f"{tmp_path}/in", df.schema, 1)
    out = L.run_to_end(L.validity_windows(L.once_per_call(calls)), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [(r.model_type, r.n, r.n_valid) for r in out.collect()] == [("a", 2, 1)]
    L.append_new(L.read_calls(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/log", f"{tmp_path}/cp2")
    L.append_new(L.read_calls(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/log", f"{tmp_path}/cp2")
    assert B.count_lines(spark, f"{tmp_path}/log") == 3
