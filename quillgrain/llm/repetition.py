"""Repeated content inside one text, decided by a short-circuit cascade of rules.

The share of repeated content of a text is the share of its ``width``-character windows (on the
normalised text) that occurred earlier in the same text. Windows are exact but costly, so cheaper
rules that are *implied* by the exact share go before them:

* ``short``      the normalised text is under ``min_chars``: never a case;
* ``sentences``  sentences that recur word for word already hold enough windows: always a case;
* ``blocks``     every window holds one of the aligned blocks of ``width - 3`` characters that start
                 at each fourth position; where too few blocks occurred earlier, never a case;
* ``windows``    the exact share, decides every text.

Each rule either decides a text for certain or passes it on, hence any order gives the same rows.
The order is chosen from measurements on a bounded sample: decided share divided by seconds.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answer_text, normalise

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 600
#: The block rule searches the text once a block; beyond this length the exact rule is cheaper.
BLOCK_RULE_CHARS = 6000
_SENTENCE = re.compile(r"[.!?。！？\n]+")


def window_share(norm: str, width: int = 10) -> float:
    """Exact share of windows that occurred earlier; 0 for a text without a window."""
    total = len(norm) - width + 1
    if total < 1:
        return 0.0
    return 1.0 - len({norm[i : i + width] for i in range(total)}) / total


def _short(raw: str, norm: str, width: int, threshold: float, min_chars: int) -> bool | None:
    return False if len(norm) < max(min_chars, width) else None


def _sentences(raw: str, norm: str, width: int, threshold: float, min_chars: int) -> bool | None:
    total = len(norm) - width + 1
    if total < 1 or len(norm) < min_chars:
        return None
    seen: set[str] = set()
    again = 0
    for part in _SENTENCE.split(raw):
        if len(part) >= width:
            part = normalise(part)
            if part in seen:
                again += max(0, len(part) - width + 1)
            else:
                seen.add(part)
    return True if again >= threshold * total and again else None


def _blocks(raw: str, norm: str, width: int, threshold: float, min_chars: int) -> bool | None:
    total, block = len(norm) - width + 1, width - 3
    if total < 1 or block < 2 or len(norm) > BLOCK_RULE_CHARS:
        return None
    budget, earlier = threshold * total, 0
    find = norm.find
    for at in range(0, len(norm) - block + 1, 4):
        if find(norm[at : at + block]) < at:
            earlier += 4
            if earlier >= budget:
                return None
    return False


def _windows(raw: str, norm: str, width: int, threshold: float, min_chars: int) -> bool | None:
    total = len(norm) - width + 1
    if total < 1 or len(norm) < min_chars:
        return False
    again = total - len({norm[i : i + width] for i in range(total)})
    return again >= threshold * total - 1e-9


RULES: dict[str, Callable[..., bool | None]] = {"short": _short, "sentences": _sentences, "blocks": _blocks, "windows": _windows}


def order_rules(texts: list[str], width: int, threshold: float, min_chars: int) -> list[str]:
    """Rules by decided texts per second on the sample; the exact rule always ends the list."""
    if not texts:
        return list(RULES)
    pairs = [(t, normalise(t)) for t in texts]
    gain = {}
    for name, rule in RULES.items():
        if name == "windows":
            continue
        began = time.perf_counter()
        decided = sum(rule(raw, norm, width, threshold, min_chars) is not None for raw, norm in pairs)
        gain[name] = decided / max(time.perf_counter() - began, 1e-9)
    return [*sorted(gain, key=lambda n: -gain[n]), "windows"]


def _sample(df: DataFrame, text: str, rows: int) -> list[str]:
    # the first rows that come, only to order the rules: no result depends on them
    return [answer_text(r[0]) for r in df.select(text).where(F.col(text).isNotNull()).limit(rows).collect()]


def repetitive_texts(df: DataFrame, keys: list[str], text: str, width: int = 10, threshold: float = 0.3, min_chars: int = 100, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The keys of the texts whose repeated share is at least ``threshold``.

    Null and empty texts are never cases; equal rows each give a row; an empty table gives none;
    columns other than ``keys`` and ``text`` are ignored, whatever their names. A text of any
    length is read whole. No shuffle: one pass over the rows.
    """
    order = order_rules(_sample(df, text, sample_rows), width, threshold, min_chars)
    names = [f"k{i}" for i in range(len(keys))]
    flat = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("body"))
    rules = [RULES[n] for n in order]

    def decide(raw: str | None) -> bool:
        raw = answer_text(raw)
        if not raw:
            return False
        norm = normalise(raw)
        for rule in rules:
            said = rule(raw, norm, width, threshold, min_chars)
            if said is not None:
                return said
        return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[decide(x) for x in b["body"]], names]

    out = flat.mapInPandas(run, flat.select(*names).schema)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)])


def repetition_shares(df: DataFrame, keys: list[str], text: str, width: int = 10) -> DataFrame:
    """Every row's ``n_chars`` (normalised) and share of repeated windows, sentences and lines.

    Nulls and empty texts give 0 in each measure.
    """
    names = [f"k{i}" for i in range(len(keys))]
    flat = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("body"))

    def again(parts: list[str]) -> float:
        parts = [p for p in (normalise(x) for x in parts) if p]
        chars = sum(map(len, parts))
        return 1.0 - sum(map(len, dict.fromkeys(parts))) / chars if chars else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = [answer_text(x) for x in b["body"]]
            norms = [normalise(x) for x in raws]
            out = b[names].copy()
            out["n_chars"] = [len(x) for x in norms]
            out["window_share"] = [round(window_share(x, width), 6) for x in norms]
            out["sentence_share"] = [round(again(_SENTENCE.split(x)), 6) for x in raws]
            out["line_share"] = [round(again(x.split("\n")), 6) for x in raws]
            yield out

    made = flat.select(*names).schema.add("n_chars", "integer").add("window_share", "double").add("sentence_share", "double").add("line_share", "double")
    out = flat.mapInPandas(run, made)
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n_chars", "window_share", "sentence_share", "line_share")
