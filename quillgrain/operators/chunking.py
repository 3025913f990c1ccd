"""Chunkers. Section chunks are a fold over ordered paragraphs, streamed row by row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrain.functions import text as T


def pack_lines(text: str, most: int) -> Iterator[str]:
    """Stripped lines packed into pieces of at most ``most`` characters; a longer line is cut there."""
    body = text.strip()
    if len(body) <= most:
        if body:
            yield body
        return
    held: list[str] = []
    size = 0
    for line in filter(None, map(str.strip, body.split("\n"))):
        grown = size + len(line) + bool(held)
        if held and grown > most:
            yield from _slices("\n".join(held), most)
            held, grown = [], len(line)
        held.append(line)
        size = grown
    if held:
        yield from _slices("\n".join(held), most)


def _slices(piece: str, most: int) -> Iterator[str]:
    yield from (piece[i : i + most] for i in range(0, len(piece), most))


def paragraphs_to_chunks(paragraphs: Iterable[str], low: int, high: int, most: int) -> Iterator[str]:
    """Paragraphs gathered towards low..high characters. The separator of the paragraph that closes
    a chunk stays counted in the next one, which is observable at the borders and kept."""
    held: list[str] = []
    size = 0
    for p in filter(None, map(str.strip, paragraphs)):
        if len(p) > most:
            if held:
                yield "\n".join(held).strip()
            held, size = [], 0
            yield from pack_lines(p, most)
            continue
        step = len(p) + bool(held)
        if held and size >= low and size + step > high:
            yield "\n".join(held).strip()
            held, size = [], 0
        held.append(p)
        size += step
        if size >= high:
            yield "\n".join(held).strip()
            held, size = [], 0
    if held:
        yield "\n".join(held).strip()


def _merge_small(chunks: Iterable[str], low: int, most: int) -> Iterator[str]:
    """A chunk under ``low`` takes in the one after it while the limit allows."""
    last = None
    for c in chunks:
        if last is not None and len(last) < low and len(last) + 1 + len(c) <= most:
            last = f"{last}\n{c}"
            continue
        if last is not None:
            yield last
        last = c
    if last is not None:
        yield last


def _absorb_tails(chunks: Iterable[str], least: int, most: int, dropped: list[str]) -> Iterator[str]:
    """A piece under ``least`` joins the one before it, or is dropped where it does not fit."""
    last = None
    for c in filter(None, map(str.strip, chunks)):
        if len(c) < least:
            if last is not None and len(last) + 1 + len(c) <= most:
                last = f"{last}\n{c}"
            else:
                dropped.append(c)
            continue
        if last is not None:
            yield last
        last = c
    if last is not None:
        yield last


def section_chunks(paragraphs: Iterable[str], low: int = 800, high: int = 1500, most: int = 2200, least: int = 120, dropped: list[str] | None = None) -> Iterator[str]:
    """Chunks of one section's ordered paragraphs; pieces too short to keep go to ``dropped``."""
    merged = _merge_small(paragraphs_to_chunks(paragraphs, low, high, most), low, most)
    yield from _absorb_tails((x for m in merged for x in pack_lines(m, most)), least, most, [] if dropped is None else dropped)


def chunk_sections(units: DataFrame, low: int = 800, high: int = 1500, most: int = 2200, least: int = 120) -> DataFrame:
    """doc_id, section, index (from 1), text, kept of units (doc_id, section, line_no, text).

    Rows are co-located and sorted by section and line; the fold reads them as they stream by and
    holds one open chunk, so a huge section needs no more memory than a small one. Dropped short
    pieces come out with ``kept`` false and index 0: the side output.
    """
    rows = units.select("doc_id", T.section_or_unknown(F.col("section")).alias("section"), "line_no", "text").where("doc_id is not null and text is not null")
    rows = rows.repartition("doc_id", "section").sortWithinPartitions("doc_id", "section", "line_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = ((r.doc_id, r.section, r.text) for b in batches for r in b.itertuples(index=False))
        pending = next(stream, None)
        out: list[tuple] = []
        while pending is not None:
            doc, section = pending[:2]

            def own() -> Iterator[str]:
                nonlocal pending
                while pending is not None and pending[:2] == (doc, section):
                    yield pending[2]
                    pending = next(stream, None)

            dropped: list[str] = []
            for i, c in enumerate(section_chunks(own(), low, high, most, least, dropped), 1):
                out.append((doc, section, i, c, True))
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=["doc_id", "section", "index", "text", "kept"])
                    out = []
            out.extend((doc, section, 0, c, False) for c in dropped)
        yield pd.DataFrame(out, columns=["doc_id", "section", "index", "text", "kept"])

    return rows.mapInPandas(run, "doc_id string, section string, index long, text string, kept boolean")


def window_chunks(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters that step by ``size - overlap``; the last one ends the text."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int") - 1)
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size``, cut at the strongest separator that occurs, with up to ``overlap`` repeated."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    mark, rest = separators[at], separators[at + 1 :]
    if mark == "":
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)]
    out: list[str] = []
    held: list[str] = []
    length = lambda xs: sum(map(len, xs)) + len(mark) * max(0, len(xs) - 1)
    for part in text.split(mark):
        if len(part) > size:
            if held:
                out.append(mark.join(held))
                held = []
            out.extend(recursive_pieces(part, size, overlap, rest))
            continue
        if held and length([*held, part]) > size:
            out.append(mark.join(held))
            while held and (length(held) > overlap or length([*held, part]) > size):
                held.pop(0)
        held.append(part)
    if held:
        out.append(mark.join(held))
    return [x.strip() for x in out if x.strip()]


# Block kinds in order of precedence with their patterns.
BLOCKS = (
    ("code", r"```[^\n]{0,20}\n[\s\S]{0,1500}?```"),
    ("math", r"\$\$[\s\S]{1,500}?\$\$"),
    ("heading", r"^#{1,6}[ \t]+[^\n]{1,200}|^[^\n]{1,200}\n(?:={2,200}|-{2,200})(?=\n|$)|<h[1-6][^>]{0,100}>[^\n]{1,200}?</h[1-6]>"),
    ("rule", r"^(?:[-*_][ \t]*){3,}$"),
    ("table", r"(?:^\|[^\n]{1,2000}\|[ \t]*(?:\n|$)){1,20}"),
    ("quote", r"(?:^>[^\n]{0,200}(?:\n|$)){1,15}"),
    ("list", r"^[ \t]{0,7}(?:[-*+•]|\d{1,3}[.)])[ \t]+[^\n]{1,800}"),
    ("citation", r"^\[[^\]\n]{1,40}\]:[^\n]{1,200}"),
    ("tag", r"<([A-Za-z][A-Za-z0-9]*)(?:\s[^>]{0,100})?>[^<]{0,1000}</\1>|<[A-Za-z/!][^>]{0,100}>"),
    ("sentence", r"[^\s.!?…。！？][^\n.!?…。！？]{0,399}(?:[.](?=\w)[^\n.!?…。！？]{0,399})*[.!?…。！？]+[\"'”’」』）)\]]*"),
    ("line", r"\S[^\n]{0,799}"),
)


def structural_blocks(text: str) -> list[tuple[int, str, str]]:
    """(position, kind, text) of the blocks of a text, in order; blanks between them are dropped."""
    pattern = re.compile("|".join(f"(?P<{k}>{p.replace(chr(92) + '1', '(?P=' + k + '_t)').replace('<([A-Za-z]', '<(?P<' + k + '_t>[A-Za-z]')})" for k, p in BLOCKS), re.MULTILINE)
    kinds = {k for k, _ in BLOCKS}
    return [(m.start(), next(k for k, v in m.groupdict().items() if k in kinds and v is not None), m[0].strip()) for m in pattern.finditer(text) if m[0].strip()]


def explode_pieces(docs: DataFrame, key: str, text: str, cut, columns: str) -> DataFrame:
    """key, place, and the columns of ``cut(text)``, whose items are tuples; null texts give none."""
    flat = docs.select(F.col(key).alias("k"), F.col(text).alias("body")).where("body is not null")
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *x) for k, body in zip(b["k"], b["body"]) for i, x in enumerate(cut(body))]
            yield pd.DataFrame(rows, columns=["k", "place", *names])

    kind = flat.schema["k"].dataType.simpleString()
    return flat.mapInPandas(run, f"k {kind}, place long, {columns}").withColumnRenamed("k", key)
