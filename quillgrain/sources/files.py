"""File sources: JSON lines, arrays and broken JSON, text folders, office documents, archives, pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quillgrain.functions import text as T


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped. Strict reading fails on a bad line, as the source tools do."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: an array of objects or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lenient(spark: SparkSession, path: str) -> DataFrame:
    """file, value (VARIANT): whole documents, single objects as one row, else every innermost ``{...}`` that parses."""
    files = read_texts(spark, path)
    whole = F.try_parse_json("text")
    is_array = F.startswith(F.schema_of_variant(whole), F.lit("ARRAY"))
    pieces = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    # trailing text after a value is accepted by the parser but is no whole document
    clean = F.col("text").rlike(r"(?s)^\s*(\[.*\]|\{.*\})\s*$") & whole.isNotNull()
    rows = F.when(clean & is_array, F.variant_get(whole, "$", "array<variant>")).when(clean & ~F.col("text").rlike(r"(?s)\}\s*\{"), F.array(whole)).otherwise(pieces)
    return files.select("file", F.explode(rows).alias("value"))


def in_name_order(listed: DataFrame, name: str = "file") -> DataFrame:
    """A listing of files with ``place``, from 1 in the order of their names; a listing is small."""
    from pyspark.sql import Window

    return listed.withColumn("place", F.row_number().over(Window.orderBy(name)).cast("long"))


def fetch_missing(wanted: DataFrame, done: DataFrame, key: str, fetch: Callable[[str], str | None], retries: int = 3) -> DataFrame:
    """key, content of what is not there yet; a failed fetch is tried again and then has a null content."""
    left = wanted.select(key).distinct().join(done.select(key), key, "left_anti")
    return left.withColumn("content", outside_column(fetch, retries)(F.col(key)))


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, text: one row for each file."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalogue; its schema is read from the file, which is small."""
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, name, sha256, n_bytes of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), T.file_stem(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def not_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key), key, "left_anti")


# ---- documents ------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraph texts of a Word file, tabs and breaks as characters."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return ["".join(n.text or "" if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in p.iter()) for p in root.iter(f"{_W}p")]


def fb2_text(content: bytes) -> str:
    root = ElementTree.fromstring(content)
    return "\n".join("".join(p.itertext()).strip() for p in root.iter() if p.tag.rpartition("}")[2] == "p")


def epub_text(content: bytes) -> str:
    """Text of the pages of an EPUB, in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(n.attrib["full-path"] for n in box.iter() if n.tag.endswith("rootfile"))
        book, base = ElementTree.fromstring(z.read(opf)), opf.rpartition("/")[0]
        hrefs = {n.attrib["id"]: n.attrib["href"] for n in book.iter() if n.tag.endswith("}item")}
        pages = [hrefs[n.attrib["idref"]] for n in book.iter() if n.tag.endswith("itemref")]
        return "\n".join(html_text(z.read(f"{base}/{p}" if base else p).decode("utf-8", "replace")) for p in pages)


def rtf_text(content: bytes) -> str:
    """Text of an RTF file: control words and groups of settings out, escapes decoded."""
    raw = content.decode("latin-1")
    raw = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", " ", raw)
    raw = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), raw)
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), raw)
    raw = re.sub(r"\\par[d]?\b ?", "\n", raw)
    return re.sub(r"[{}]|\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]", "", raw).strip()


def html_text(page: str) -> str:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.parts: list[str] = []
            self.skip = 0

        def handle_starttag(self, tag, attrs) -> None:
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag) -> None:
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, data) -> None:
            if not self.skip:
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    return re.sub(r"\n+", "\n", "".join(reader.parts)).strip()


READERS: dict[str, Callable[[bytes], str]] = {
    "docx": lambda b: "\n".join(p for p in docx_paragraphs(b) if p.strip()),
    "fb2": fb2_text,
    "epub": epub_text,
    "rtf": rtf_text,
    "md": lambda b: b.decode("utf-8", "replace"),
    "txt": lambda b: b.decode("utf-8", "replace"),
}


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """file, kind, text, error of a folder of mixed documents, by suffix.

    Kinds without a reader, such as pdf where no library is installed, and broken files give a null
    text and an error instead of a failure; ``readers`` adds kinds.
    """
    known = {**READERS, **(readers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["file"], b["content"]):
                kind = file.rpartition(".")[2].lower()
                try:
                    rows.append((file, kind, known[kind](content), None) if kind in known else (file, kind, None, "unsupported"))
                except Exception as e:  # noqa: BLE001 - a broken file is a row of the error log
                    rows.append((file, kind, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["file", "kind", "text", "error"])

    return files.mapInPandas(run, "file string, kind string, text string, error string")


def read_docx_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem), line_no, line: normalised paragraphs of Word files, empty ones dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path).select(T.file_stem(F.col("path")).alias("doc_id"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, p) for d, c in zip(b["doc_id"], b["content"]) for i, p in enumerate(docx_paragraphs(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "line"])

    lines = files.mapInPandas(run, "doc_id string, line_no long, line string")
    return lines.withColumn("line", T.normalize_line(F.col("line"))).where("line <> ''")


def unzip(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".pdf", ".doc", ".docx")) -> DataFrame:
    """archive, name (base name), sha256, content of the wanted members of ZIP files; an archive without any is an error row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("archive"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, content in zip(b["archive"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [(archive, n.rpartition("/")[2], z.read(n), None) for n in z.namelist() if n.lower().endswith(suffixes)]
                rows.extend(found or [(archive, None, None, "no document inside")])
            yield pd.DataFrame(rows, columns=["archive", "name", "content", "error"])

    return files.mapInPandas(run, "archive string, name string, content binary, error string").withColumn("sha256", F.sha2("content", 256))


def video_cards(html: Column) -> Column:
    """array<struct<url, title, views>>: the links of a search page with their titles and view counts."""
    cards = F.regexp_extract_all(html, F.lit(r'(?s)<div[^>]*class="[^"]*video[^"]*"[^>]*>.*?</div>'), F.lit(0))
    return F.transform(cards, lambda c: F.struct(F.regexp_extract(c, r'href="([^"]+)"', 1).alias("url"), F.trim(F.regexp_replace(F.regexp_extract(c, r"(?s)<h3[^>]*>(.*?)</h3>", 1), "<[^>]+>", "")).alias("title"), F.regexp_extract(c, r'class="[^"]*view[^"]*"[^>]*>\s*([^<]*?)\s*<', 1).alias("views")))


# ---- outside models -------------------------------------------------------------------------


def outside_column(call: Callable[[str], str | None], retries: int = 1):
    """A text -> text column over any outside service (language model, OCR, speech, page fetch).

    A failure is tried again, then gives null; pair it with ``failed`` to log it.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            for _ in range(retries + 1):
                try:
                    return None if x is None else call(x)
                except Exception:  # noqa: BLE001 - the service's failure is a null, not the job's
                    continue
            return None

        return values.map(one)

    return run.asNondeterministic()


def in_batches(rows: DataFrame, text: str, call: Callable[[list[str]], list[str]], size: int = 10, pause: float = 0.0, back_off: float = 0.0) -> DataFrame:
    """The rows with ``result``, asked for ``size`` texts at a time, with a pause between and one retry after ``back_off``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            out: list = []
            for at in range(0, len(b), size):
                part = b[text].iloc[at : at + size].tolist()
                try:
                    out.extend(call(part))
                except Exception:  # noqa: BLE001
                    time.sleep(back_off)
                    out.extend(call(part))
                time.sleep(pause)
            yield b.assign(result=out)

    return rows.mapInPandas(run, T_.StructType([*rows.schema.fields, T_.StructField("result", T_.StringType())]))
