"""Column functions on text. All stay inside Catalyst; lengths are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a character class that Java and RE2 read alike.
BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The line and heading patterns of the paragraph rules.
PAGE_LINE = r"(?i)^page[ ]+[0-9]+([ ]+of[ ]+[0-9]+)?[ ]*$"
TOC_LINE = r"[ ][0-9]{1,4}$"
BOX_CHARS = r"[┌┐└┘─│]"
HEADING = r"^(Annex [A-Z]|[A-Z]\.[0-9]+(?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)*)([^\p{L}\p{N}_].*)?$"
# Word classes of question types.
DEFINITION = r"(?i)\b(is|refers to|defined as)\b"
CONDITION = r"(?i)\bshall\b|\bwhen\b|\bif\b"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda an expression is computed for every element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")


def normalize_line(col: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; stripped."""
    return F.trim(F.regexp_replace(col, f"{BLANK}+", " "))


def is_page_number(line: Column) -> Column:
    """A line of digits only, or ``Page 3`` / ``page 3 of 9``."""
    return line.rlike("^[0-9]+$") | line.rlike(PAGE_LINE)


def is_table_noise(line: Column, raw: Column | None = None) -> Column:
    """Empty, three pipes or more, or box-drawing characters; with the ``raw`` line also six blanks in
    a row, which a normalised line cannot have."""
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    noise = (line == "") | (pipes >= 3) | line.rlike(BOX_CHARS)
    return noise if raw is None else noise | raw.rlike(f"{BLANK}{{6,}}")


def is_toc_like(line: Column) -> Column:
    """A line that ends in a blank and a number of up to four digits; prose may, too."""
    return line.rlike(TOC_LINE)


def heading(line: Column) -> tuple[Column, Column]:
    """(section, title) of a heading line, else nulls; the title is null where a heading has none."""
    empty = F.lit("")
    return F.nullif(F.regexp_extract(line, HEADING, 1), empty), F.nullif(F.ltrim(F.regexp_extract(line, HEADING, 2)), empty)


def file_stem(path: Column) -> Column:
    """The file name without folder and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def short_doc(doc_id: Column) -> Column:
    """Letters and digits, upper case, at most 24; ``DOC`` for none."""
    kept = F.substring(F.upper(F.regexp_replace(F.coalesce(doc_id, F.lit("")), "[^0-9A-Za-z]", "")), 1, 24)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("DOC"))


def section_or_unknown(section: Column) -> Column:
    """The stripped section, ``UNKNOWN`` for null or empty."""
    return F.when(section.isNull() | (section == ""), F.lit("UNKNOWN")).otherwise(strip(section))


def chunk_id(doc_id: Column, section: Column, index: Column) -> Column:
    """Short document, section without marks and blanks, and the four-digit place in the group."""
    return F.concat_ws("-", short_doc(doc_id), F.regexp_replace(section_or_unknown(section), "[^0-9A-Za-z.]", ""), F.when(index > 9999, index.cast("string")).otherwise(F.lpad(index.cast("string"), 4, "0")))


def sentences(col: Column) -> Column:
    """Pieces after ``. ? ! ; :`` and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col, r"(?<=[.?!;:])\s+"), strip), lambda x: x != "")


def within(parts: Column, low: int, high: int) -> Column:
    """The parts whose length lies in low..high."""
    return F.filter(parts, lambda x: (F.length(x) >= low) & (F.length(x) <= high))


def quote_candidates(col: Column) -> Column:
    """Sentences of 60 to 240 characters, where there are none of 30 to 300."""
    def choose(own: Column) -> Column:
        return let(within(own, 60, 240), lambda first: F.when(F.size(first) > 0, first).otherwise(within(own, 30, 300)))

    return let(sentences(col), choose)


def shorten(col: Column, most: int = 120) -> Column:
    """The text, or its first characters and an ellipsis where it is longer."""
    return F.when(F.length(col) > most, F.concat(F.rtrim(F.substring(col, 1, most)), F.lit("..."))).otherwise(col)


def preview(col: Column, most: int = 200) -> Column:
    """Like ``shorten``, without trimming before the ellipsis."""
    return F.when(F.length(col) > most, F.concat(F.substring(col, 1, most), F.lit("..."))).otherwise(col)


def bullets(col: Column, most: int = 10) -> Column:
    """The first non-blank lines as a list with dashes."""
    lines = F.filter(F.transform(F.split(col, "\n"), strip), lambda x: x != "")
    return F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")


def evidence_block(chunk: Column, doc: Column, section: Column, text: Column) -> Column:
    """The header line of a chunk and its text; null parts are written as ``None``."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("[chunk_id="), part(chunk), F.lit(" doc_id="), part(doc), F.lit(" section="), part(section), F.lit("]\n"), F.coalesce(text, F.lit("")))


def user_prompt(question: Column, evidence: Column) -> Column:
    """Question and evidence under the two fixed labels."""
    return F.concat(F.lit("问题: "), F.coalesce(question, F.lit("")), F.lit("\n证据:\n"), F.coalesce(evidence, F.lit("")), F.lit("\n"))


def full_prompt(system: Column, user: Column) -> Column:
    """System and user text, stripped, with a blank line between."""
    return F.concat(strip(F.coalesce(system, F.lit(""))), F.lit("\n\n"), strip(user), F.lit("\n"))


def word_ngrams(col: Column, n: int = 3) -> Column:
    """Distinct n-grams of the lower-case words ``[a-z0-9_-]+``; empty for fewer than n words."""
    def grams(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(F.lower(col), F.lit(r"[a-z0-9_\-]+"), F.lit(0)), grams)


def coverage(answer: Column, evidence: Column, n: int = 3) -> Column:
    """Share of the answer's n-grams that the evidence has; 0 where either side has none."""
    def share(a: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(a, word_ngrams(evidence, n))).cast("double"), F.nullif(F.size(a), F.lit(0)).cast("double")), F.lit(0.0))

    return let(word_ngrams(answer, n), share)


def count_cjk(col: Column) -> Column:
    """Characters of the basic CJK block."""
    return F.length(col) - F.length(F.regexp_replace(col, "[一-鿿]", ""))


# The subtitle cleaner's ordered replacements (pattern, replacement).
TRANSCRIPT_STEPS = (
    (r"\[[0-9]+,[0-9]{2}:[0-9]{2}\]\s*< No Speech >", ""),
    (r"\[[0-9]+,[0-9]{2}:[0-9]{2}\]", ""),
    (r"< No Speech >", ""),
    (r"(?s)<video.*?>.*?</video>", ""),
    (r"(?s)Texts generated.*?\.srt\)", ""),
    (r"(?s)Mark the sentences.*?subtitle context\.", ""),
    (rf"- \[.*?\]{BLANK}*", ""),
    (rf"<-- Mark if you are done editing\.{BLANK}*\.", ""),
)


def clean_transcript(col: Column) -> Column:
    """Subtitle text without time stamps and markers, blanks before and after marks gone, other
    blanks turned into commas, symbols dropped. CJK marks are symbols here, as in the source rules."""
    out = col
    for pattern, new in TRANSCRIPT_STEPS:
        out = F.regexp_replace(out, pattern, new)
    out = normalize_line(out)
    out = F.regexp_replace(out, r" ([.,!?;:])", "$1")
    out = F.regexp_replace(out, r"([.,!?;:]) ", "$1")
    out = F.regexp_replace(out, r"([^ ]) +([^ ])", "$1,$2")
    out = F.replace(out, F.lit("。,"), F.lit("。"))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\p{M}_\s.,!?;:]", "")


def scrub_qa_json(col: Column) -> Column:
    """Without blanks, line ends and fences, and without the first ``json``."""
    out = F.replace(F.replace(F.replace(col, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_replace(out, "(?s)^(.*?)json", "$1")


def scrub_literal(col: Column, drop_brackets: bool = False) -> Column:
    """A model's list or dict with fences dropped and typographic marks made plain."""
    out = F.regexp_replace(col, "```(?:json|python)?", "")
    out = F.translate(out, "“”，", '"",')
    return F.translate(out, "[]", "") if drop_brackets else strip(out)


def says_true(col: Column) -> Column:
    """Does the reply hold ``true``?"""
    return F.contains(col, F.lit("true"))


def json_escape(col: Column) -> Column:
    """The text as inside a JSON string, without the quotes."""
    whole = F.to_json(F.struct(col.alias("s")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def first_line_unquoted(col: Column) -> Column:
    """The first line without double quotes."""
    return F.replace(F.split_part(col, F.lit("\n"), F.lit(1)), F.lit('"'), F.lit(""))


def wish_label(name: Column, scene: Column, style: Column, plain: str = "正常") -> Column:
    """Name and scene of a wish, and its style unless that is the plain one."""
    return F.concat(F.lit("祝"), name, scene, F.when(style.isNull() | (style == plain), F.lit("")).otherwise(F.concat(F.lit(","), style, F.lit("风格"))))


def safe_filename(col: Column) -> Column:
    """Blanks and slashes as underscores."""
    return F.translate(col, " /\\", "___")


def mark_quotes(text: Column, quotes: Column, least: int = 3) -> Column:
    """Each quote, longest first and in any case, set between ``<mark>`` tags."""
    long = F.filter(quotes, lambda q: F.length(q) >= least)
    ordered = F.array_sort(long, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(ordered, text, lambda acc, q: F.regexp_replace(acc, F.concat(F.lit("(?i)(\\Q"), F.replace(q, F.lit("\\E"), F.lit("")), F.lit("\\E)")), F.lit("<mark>$1</mark>")))


def metric_text(value: Column) -> Column:
    """``N/A`` for null, a percentage for 0..1, else two decimals."""
    return F.when(value.isNull(), F.lit("N/A")).when((value >= 0) & (value <= 1), F.format_string("%.1f%%", value * 100)).otherwise(F.format_string("%.2f", value))


def flag_text(value: Column) -> Column:
    """A mark for true and false, ``N/A`` for null."""
    return F.when(value.isNull(), F.lit("N/A")).when(value, F.lit("✅")).otherwise(F.lit("❌"))


def trend(base: Column, now: Column, share: float = 0.1) -> Column:
    """``up`` or ``down`` beyond the share of the base, ``flat`` within; empty for base 0."""
    delta = F.try_divide(now - base, base)
    return F.when(base.isNull() | (base == 0), F.lit("")).when(delta > share, F.lit("up")).when(delta < -share, F.lit("down")).otherwise(F.lit("flat"))


def first_heading_level(col: Column) -> Column:
    """``#`` or ``##`` of the first heading of level one or two, empty without one."""
    return F.regexp_extract(col, r"(?m)^\s*(#{1,2})(?!#)\s", 1)


def chinese_colons(col: Column) -> Column:
    return F.replace(col, F.lit(":"), F.lit("："))


def catalogue_number(name: Column) -> Column:
    """The number in the first two characters of a file name, null without one."""
    return F.substring(name, 1, 2).try_cast("int")


def stamp(ts: Column) -> Column:
    """``YYYYMMDD_HHMMSSmmm``."""
    return F.date_format(ts, "yyyyMMdd_HHmmssSSS")


def clean_for_embedding(col: Column) -> Column:
    """Line ends as blanks."""
    return F.replace(col, F.lit("\n"), F.lit(" "))


def as_metadata(col: Column) -> Column:
    """A value as metadata text; null is empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def brace_object(col: Column) -> Column:
    """The first balanced stretch of braces, counted without regard to quotes; empty for none.

    Braces only change the depth, so the fold runs over brace positions, not characters.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(F.endswith(part, F.lit("{")), 1).otherwise(-1)
        at = acc["at"] + F.length(part)
        return F.struct(depth.cast("int").alias("depth"), at.cast("int").alias("at"), F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"]).cast("int").alias("end"))

    def balanced(rest: Column) -> Column:
        parts = F.regexp_extract_all(rest, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
        return F.substr(rest, F.lit(1), F.aggregate(parts, start, step)["end"])

    return F.coalesce(let(F.regexp_replace(col, r"(?s)^[^{]+", ""), balanced), F.lit(""))
