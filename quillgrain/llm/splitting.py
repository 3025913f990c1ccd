"""Cutting oversized texts into pieces under a limit, at the text's own pauses.

Balanced targets: the smallest piece count that can hold the text is computed, equal-length
targets are placed, each target is snapped to the strongest boundary near it, and a piece is added
whenever any piece would break the limit. Only where no pause is in reach is a cut forced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary kinds from the strongest to the weakest; a cut falls right after the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t\r　]*\n\s*")),
    ("line", re.compile(r"\r?\n\s*")),
    ("sentence", re.compile(r"[.!?。！？]+[\"'”’」』）)\]]*\s*")),
    ("clause", re.compile(r"[;:,；：，、]\s*")),
    ("space", re.compile(r"\s+")),
)
PAUSE = re.compile(r"[\s.!?;:,。！？；：，、]")


def longest_run(text: str) -> int:
    """Most characters in a row without white space or a pause mark."""
    return max(map(len, PAUSE.split(text)), default=0)


def run_around(text: str, at: int) -> int:
    """Length of the run without a pause that a cut at ``at`` divides; 0 where it falls at a pause."""
    if PAUSE.match(text[at - 1]) or PAUSE.match(text[at]):
        return 0
    after = PAUSE.search(text, at)
    start = at
    while start and not PAUSE.match(text[start - 1]):
        start -= 1
    return (after.start() if after else len(text)) - start


def _cut(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Ends of the pieces' own parts with the kind of each end; the last is (len(text), "end")."""
    n = len(text)
    if n <= limit:
        return [(n, "end")]
    places = []
    for _, pattern in BOUNDARIES:
        at = [m.end() for m in pattern.finditer(text)]
        places.append(at)
    count = 1 + -(-(n - limit) // (limit - overlap))
    while True:
        ends, start, fits = [], 0, True
        for k in range(1, count):
            room = limit if not ends else limit - overlap
            target = start + (n - start) / (count - k + 1)
            # the rest must still fit into the pieces that are left
            least = max(start + 1, n - (count - k) * (limit - overlap))
            most = min(start + room, n - 1)
            found = None
            reach = max(1.0, (n / count) / 4)
            for spread in (reach, float(n)):  # near the target first, then anywhere that is allowed
                for (kind, _), at in zip(BOUNDARIES, places):
                    lo, hi = bisect_left(at, max(least, target - spread)), bisect_right(at, min(most, target + spread))
                    if lo < hi:
                        best = min(at[lo:hi], key=lambda p: (abs(p - target), p))
                        found = (best, kind)
                        break
                if found:
                    break
            if found is None:
                # no pause between least and most: an earlier one costs a piece, none at all takes the
                # room of the overlap or forces the cut
                if _last(places, start, most):
                    fits = False
                    break
                found = _widened(text, limit, start, most, ends, places)
                if found is None and least > most:
                    fits = False
                    break
                found = found or _hard(text, start, most)
                if found[0] < least:
                    fits = False
                    break
            ends.append(found)
            start = found[0]
            if start == n:
                return ends
        if fits:
            room = limit - overlap if ends else limit
            if n - start <= room or not _last(places, start, start + room) and _widened(text, limit, start, start + room, ends, places) == (n, "end"):
                return [*ends, (n, "end")]
        count += 1
        if count > 2 * n // max(1, limit - overlap) + 8:
            return _greedy(text, limit, overlap, places)


def _hard(text: str, start: int, most: int) -> tuple[int, str]:
    """A cut where no boundary ends: at the last mark whose closers would not fit, else inside a run."""
    if PAUSE.match(text[most]):
        return most, "edge"
    at = most
    while at > start + 1 and most - at < 8 and not PAUSE.match(text[at - 1]):
        at -= 1
    return (at, "edge") if at > start + 1 and PAUSE.match(text[at - 1]) else (most, "forced")


def _last(places: list[list[int]], start: int, most: int) -> tuple[int, str] | None:
    """The last pause after ``start`` up to ``most``, of the strongest kind that ends there."""
    best = max(((at[i - 1], -k) for k, at in enumerate(places) if (i := bisect_right(at, most)) and at[i - 1] > start), default=None)
    return (best[0], BOUNDARIES[-best[1]][0]) if best else None


def _widened(text: str, limit: int, start: int, most: int, ends: list[tuple[int, str]], places: list[list[int]]) -> tuple[int, str] | None:
    """The end of a piece whose run reaches beyond ``most`` but fits the limit, once this piece's
    overlap gives way; None where the run does not fit or is the rest of a forced cut.
    """
    wide = min(start + limit, len(text))
    if most >= wide or ends and ends[-1][1] == "forced":
        return None
    if len(text) <= wide and not any(at[i] < len(text) for at in places if (i := bisect_right(at, most)) < len(at)):
        return len(text), "end"
    first = min(((at[i], k) for k, at in enumerate(places) if (i := bisect_right(at, most)) < len(at) and at[i] <= wide), default=None)
    if first:
        return first[0], BOUNDARIES[first[1]][0]
    # the run fits, its marks do not: they go to the next piece
    run = PAUSE.search(text, most)
    return (run.start(), "edge") if run and run.start() <= wide else None


def _greedy(text: str, limit: int, overlap: int, places: list[list[int]]) -> list[tuple[int, str]]:
    """The last allowed pause each time, a forced cut where there is none; ends for any text."""
    n, start, ends = len(text), 0, []
    while n - start > (limit - overlap if ends else limit):
        most = start + (limit - overlap if ends else limit)
        ends.append(_last(places, start, most) or _widened(text, limit, start, most, ends, places) or _hard(text, start, most))
        start = ends[-1][0]
        if start == n:
            return [*ends[:-1], (n, "end")]
    return [*ends, (n, "end")]


def split_text(text: str | None, limit: int = 2200, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """(start, own start, end, kind of the end) of each piece of the trimmed text.

    ``own start - start`` characters repeat the end of the piece before: ``overlap`` of them, fewer
    only in a piece that begins with a run without any pause and needs the room to hold it. The own parts in order give the trimmed text
    back. Null and blank texts have no piece.
    """
    body = (text or "").strip()
    if not body:
        return []
    out, own = [], 0
    for end, kind in _cut(body, limit, overlap):
        out.append((max(0, own - min(overlap, limit - (end - own))) if own else 0, own, end, kind))
        own = end
    return out


def split_oversized(df: DataFrame, key: str, text: str, section: str, limit: int = 2200, overlap: int = 200) -> DataFrame:
    """Pieces of the rows whose trimmed text is longer than ``limit`` characters.

    Columns: key, section, piece_no (from 1), n_pieces, start, own_start, end_at, cut
    (``paragraph line sentence clause space``, ``edge`` between a run that fills its piece and its
    mark, ``forced`` inside a run, or ``end``), boundary (of the row: ``forced`` where a piece ends
    inside a run without pause that is longer than the limit, else ``natural``), piece. Null or short
    texts give no row, null sections stay null, equal rows give their pieces each; other columns
    are ignored. One pass, no shuffle.
    """
    flat = df.select(F.col(key).alias("k"), F.col(section).alias("s"), F.col(text).alias("body")).where(F.length("body") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, s, body in zip(b["k"], b["s"], b["body"]):
                body = body.strip()
                if len(body) <= limit:
                    continue
                pieces = split_text(body, limit, overlap)
                kind_of_row = "forced" if any(run_around(body, end) > limit for _, _, end, _ in pieces[:-1]) else "natural"
                for i, (a, own, z, kind) in enumerate(pieces, 1):
                    rows.append((k, s, i, len(pieces), a, own, z, kind, kind_of_row, body[a:z]))
            yield pd.DataFrame(rows, columns=["k", "s", "piece_no", "n_pieces", "start", "own_start", "end_at", "cut", "boundary", "piece"])

    made = flat.select("k", "s").schema
    for name, kind in (("piece_no", "integer"), ("n_pieces", "integer"), ("start", "integer"), ("own_start", "integer"), ("end_at", "integer"), ("cut", "string"), ("boundary", "string"), ("piece", "string")):
        made = made.add(name, kind)
    return flat.mapInPandas(run, made).withColumnsRenamed({"k": key, "s": section})
