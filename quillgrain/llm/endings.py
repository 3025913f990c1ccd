"""How a text ends: with a final mark, open, or visibly broken, and whether an open end is a cut.

Whether an open end is whole in its kind (a list of terms, a wish, a reference) or breaks off is
learned, not listed: a logistic model over the last characters, the last clause and the shape of
the last lines is taught by values known to be cut and scores every other one by models that did
not see its text.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np

from .common import json_object

CLOSED, OPEN, BROKEN = 0, 1, 2

_MARKS = ".!?;。！？；"
_CLOSERS = "\"'”’』」》】）)]>`*~～|"
_TRAILING_COMMA = re.compile(r",(\s*[}\]])")
_BULLET = re.compile(r"^\s*(?:[-*•·+]|\d{1,3}[.)、])\s*")
_FULL_STOP = re.compile(r"[.!?;。！？；]+\s|[!?;。！？；]+")
_PARTS = re.compile(r"[,，、:：]")
_ANSWER_STRING = re.compile(r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)', re.DOTALL)

#: Features of an ending, their hash space, and the folds of texts that are scored by a model of the others.
WIDTH, SIZE, FOLDS = 22, 1 << 17, 3
#: Where among the features the last five characters are, and in how many steps their frequency is told.
LAST_FIVE, STEPS = 4, 8
#: A feature that fewer endings of the fit have is left out.
LEAST_SEEN = 10


def lenient_object(text: str) -> dict | None:
    """An object, also one with commas before its closing marks."""
    found = json_object(text)
    if found is None and "{" in text and _TRAILING_COMMA.search(text):
        found = json_object(_TRAILING_COMMA.sub(r"\1", text))
    return found


def is_symbol(char: str) -> bool:
    """Emoji and other pictures, which people set after a finished sentence."""
    code = ord(char)
    return 0x2190 <= code <= 0x2BFF or 0x1F000 <= code <= 0x1FAFF or code in (0xFE0F, 0x200D)


def final_mark(text: str) -> int:
    """CLOSED after a final mark, closing bracket, quote or symbol and for blank texts; BROKEN where
    a character is cut or dots stand in for the rest of a word or sentence; else OPEN.
    """
    s = text.rstrip()
    if not s:
        return CLOSED
    last = s[-1]
    if last == "\ufffd":
        return BROKEN
    if last == "…":
        bare = s.rstrip("….")
        return CLOSED if not bare or bare[-1] in _MARKS or bare[-1] in _CLOSERS else BROKEN
    return CLOSED if last in _MARKS or last in _CLOSERS or is_symbol(last) else OPEN


def _shape(s: str) -> str:
    """Kinds of characters in a row: han, kana, small and capital letters, digits, blanks, marks."""
    out: list[str] = []
    for c in s:
        kind = "h" if "㐀" <= c <= "鿿" else "k" if "぀" <= c <= "ヿ" else "9" if c.isdigit() else "_" if c in " \t" else c if not c.isalpha() else "a" if c.islower() else "A"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def cut_features(text: str) -> list[int]:
    """WIDTH hashed features of an open end. The text's length has no part in them."""
    s = text.rstrip()
    low = s[-8:].lower()
    lines = s.split("\n")
    line = lines[-1]
    fragment = _FULL_STOP.split(line)[-1].strip()
    clause = _PARTS.split(fragment)[-1].strip()
    before = lines[-2].rstrip()[-1:] if len(lines) > 1 else "^"
    before = before if before and (before in _MARKS or before in _CLOSERS or before in "^:：,，") else "x"
    item = len(lines) > 1 and _BULLET.match(line) is not None
    told = _FULL_STOP.search(s) is not None
    alone = fragment == s.strip()
    sizes = [len(x) for x in re.split(r"[,，、]", fragment)]
    words = s.split()
    at = s.find(s[-6:], 0, len(s) - 1) if len(s) > 12 else -1  # where the same end was met before
    named = [f"{n} {low[-n:]}" for n in range(1, 6)]
    named += [
        f"word {fragment.split(' ')[-1].lower()[:12]}",
        f"clause {min(len(clause), 12)}",
        f"shape {_shape(fragment[-40:])[-12:]}",
        f"line {_shape(line[:3])} {_shape(line[-8:])[-4:]}",
        f"before {before} {item}",
        f"fragment {min(int(math.log2(len(fragment) + 1)), 5)} {item}",
        f"alone {min(len(fragment) // 4, 8) if alone else '-'}",
        f"told {told} {item} {before}",
        f"again {len(clause) > 1 and s[: -len(clause)].count(clause) > 0}",
        f"equal {len(sizes) > 2 and len(set(sizes[1:])) == 1} {min(sizes[-1], 6)}",
        f"prose {told and not item and bool(fragment)} {len(s) > 60}",
        f"items {item} {item and not any(map(_FULL_STOP.search, lines[:-1])) and max(map(len, lines)) <= 60}",
        f"tail {_shape(s[-3:])} {item}",
        f"words {min(fragment.count(' '), 6)} {alone}",
        f"word before {len(words) > 2 and words[-1] in words[:-1]} {len(words) > 2}",
        f"went on {_shape(s[at + 6 : at + 7]) if at >= 0 else '-'}",
        f"turn {_shape(clause[:1])} {_shape(clause[-1:])} {len(sizes) > 1}",
    ]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % SIZE for x in named]


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS


# texts that teach the first rules where the data hold few open ends
_SEED_PROSE = (
    "先关进水阀。再打开排水阀，等水位降到刻度以下。最后记录时间，并把记录交给值班的人。",
    "Close the inlet valve first. Then open the drain and wait until the level falls. Note the time at the end, and hand the sheet over.",
)
_SEED_WHOLE = ("Yes", "两次", "Items:\n- inlet valve\n- drain", "清单：\n- 进水阀\n- 排水阀", "See part 3.2", "红花，白花，黄花，蓝花", "Lamp 4", "3")


class Endings:
    """Log-odds that an open end is a cut, one column of weights for each fold that was left out.

    ``common`` says for each last five characters how many open ends of the fit share them, as a
    feature of its own: what ends many texts is an ending, cuts fall anywhere.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray, common: np.ndarray):
        self.weights, self.bias, self.common = weights, bias, common

    def score(self, features: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Log-odds of rows of ``cut_features``."""
        if not len(features):
            return np.empty(0)
        return self.weights[features, fold[:, None]].sum(1) + self.weights[self.common[features[:, LAST_FIVE]], fold] + self.bias[fold]

    def cut(self, text: str) -> float:
        """Log-odds that the open end of ``text`` is a cut."""
        fold, found = fold_of(text), cut_features(text)
        return float(self.weights[found, fold].sum() + self.weights[self.common[found[LAST_FIVE]], fold] + self.bias[fold])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, used: np.ndarray, steps: int = 60, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by Adam; every row of ``x`` has WIDTH features below ``used``."""
    weight = weight / weight.sum()
    w, b = np.zeros(used), 0.0
    m, v = np.zeros(used + 1), np.zeros(used + 1)
    flat = x.ravel()
    for step in range(1, steps + 1):
        e = (1.0 / (1.0 + np.exp(-np.clip(w[x].sum(1) + b, -30, 30))) - y) * weight
        g = np.append(np.bincount(flat, np.repeat(e, x.shape[1]), used) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[0] = 0.0
        w, b = w - move[:-1], b - move[-1]
    w[0] = 0.0
    return w, b


def fit_endings(features: np.ndarray, fold: np.ndarray, cut: np.ndarray, made: np.ndarray, rounds: int = 5) -> Endings:
    """The model from open ends and made cuts.

    ``features`` and ``fold`` are of values with an open end, ``cut`` says which of them are known to
    be cut (they end at a length limit); the others are taken for whole at first, and again as the
    models of the other folds see them. ``made`` are features of sound values cut anywhere.
    """
    seeds = [x[:i] for x in _SEED_PROSE for i in range(6, len(x) - 1) if final_mark(x[:i]) == OPEN]
    whole = list(_SEED_WHOLE)
    x = np.array([*features.reshape(-1, WIDTH).tolist(), *made.reshape(-1, WIDTH).tolist(), *map(cut_features, seeds), *map(cut_features, whole)], dtype=np.int64)
    n = len(features)
    often = np.bincount(features.reshape(-1, WIDTH)[:, LAST_FIVE], minlength=SIZE) if n else np.zeros(SIZE, dtype=np.int64)
    common = (SIZE + np.minimum(STEPS - 1, np.log2(np.maximum(often, 4) / 4).astype(np.int64))).astype(np.int32)
    x = np.hstack([x, common[x[:, LAST_FIVE : LAST_FIVE + 1]]])
    parts = np.concatenate([fold, np.arange(len(x) - n) % FOLDS])
    own = np.zeros(len(x), dtype=bool)
    own[n + len(made) :] = True
    seen = np.bincount(x.ravel(), minlength=SIZE + STEPS)
    seen[np.unique(x[own])] += LEAST_SEEN
    used = np.flatnonzero(seen >= LEAST_SEEN)
    place = np.zeros(SIZE + STEPS, dtype=np.int64)
    place[used] = np.arange(1, len(used) + 1)
    x = place[x]
    fixed = np.concatenate([cut.astype(bool), np.ones(len(made) + len(seeds), dtype=bool), np.zeros(len(whole), dtype=bool)])
    y = fixed.copy()
    weights, bias = np.zeros((SIZE + STEPS, FOLDS), dtype=np.float32), np.zeros(FOLDS)
    base = np.ones(len(x))
    base[n : n + len(made)] = max(1.0, cut.sum()) / max(1, len(made))  # made cuts count as much as the known ones
    for turn in range(rounds):
        out = np.zeros(len(x))
        for f in range(FOLDS):
            fit = np.flatnonzero((parts != f) | own)
            pos, neg = (base[fit] * y[fit]).sum(), (base[fit] * ~y[fit]).sum()
            w, b = _logistic(x[fit], y[fit].astype(float), base[fit] * np.where(y[fit], 1 / max(pos, 1e-9), 1 / max(neg, 1e-9)), len(used) + 1)
            out[parts == f] = w[x[parts == f]].sum(1) + b
            weights[used, f], bias[f] = w[1:], b
        if turn < rounds - 1:
            y = fixed.copy()
            y[:n] |= out[:n] > 0
    return Endings(weights, bias, common)


def looks_like_object(text: str) -> bool:
    """Does the reply set out to be an object, after a fence or a lead-in line?"""
    return bool(re.match(r"(?:[^{}\n]{0,60}\n)?\s*(?:```\w*\s*)?\{\s*[\"}\n]", text.lstrip()))


class Reply:
    """A reply taken apart: ``body`` is the answer text, ``found`` the object, ``state`` the final mark."""

    __slots__ = ("body", "found", "inner", "state", "broken_object")

    def __init__(self, text: str):
        self.found = lenient_object(text) if "{" in text else None
        self.broken_object = False
        if self.found is not None and isinstance(self.found.get("answer"), str):
            self.body, self.inner = self.found["answer"], True
            self.state = final_mark(self.body)
        elif self.found is None and looks_like_object(text):
            s = text.rstrip().rstrip("`").rstrip()
            hit = _ANSWER_STRING.search(text)
            self.body, self.inner = (_unescape(hit[1]) if hit else text), True
            self.broken_object = not s.endswith("}") or s.count("{") > s.count("}")
            self.state = BROKEN if self.broken_object else CLOSED
        else:
            self.body, self.inner = text, False
            self.state = final_mark(text)


def _unescape(raw: str) -> str:
    try:
        return json.loads(f'"{raw}"')
    except ValueError:
        return raw.replace("\\n", "\n").replace('\\"', '"')
