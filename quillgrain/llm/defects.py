"""Broken prompt and response pairs, by a conditional random field over the clauses of a reply.

Each clause is tagged answer, refusal, echo, foreign or unfinished by a linear-chain CRF; the share
of a reply's letters under each tag decides its defect. Its features come from the text: hashed
character n-grams of the clause and of its edges, how much of it the question holds and the other
way round, scripts, and what the learned statistic of endings says about an open end. The field is
trained here, on sound replies of the data turned into each defect: cut, refused, echoed, put into
another language. How replies of these data decline is mined from the rows that may decline.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.session import write_shared

from .common import PLACEHOLDERS, normalise, question_of
from . import truncation
from .endings import BROKEN, CLOSED, OPEN, Endings, Reply

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Sound replies that are spoiled for training (five times as many teach as they are), and the rows of
#: either kind among which they and the ways to decline are looked for; the documented bounds of the fit.
FIT_REPLIES, FIT_ROWS = 400, 4000

# Refusals that the training sequences are made with.
REFUSALS = {
    "zh": ("抱歉，我无法回答这个问题。", "对不起，作为语言模型，我不能提供相关建议。", "很遗憾，这件事我帮不了您。", "该请求超出我的能力范围。", "我没有权限处理此事。", "恕难奉告。", "这个问题不便作答。"),
    "en": ("I'm sorry, but I can't help with that.", "I must decline to answer.", "As a language model I am unable to answer this.", "No answer can be given here.", "I cannot say more; please consult a professional."),
    "ja": ("申し訳ありませんが、お答えできません。",),
}
# Sentences that stand for another language where the data have none in it.
STRANGE = {
    "ja": ("先に給水弁を閉めてください。", "左のランプが先に点灯し、三秒後に右が点きます。"),
    "es": ("Primero se cierra la válvula de entrada y después se abre el desagüe.", "La lámpara izquierda se enciende antes que la derecha."),
    "fr": ("On ferme d'abord la vanne d'entrée, puis on ouvre la vidange.", "La lampe de gauche s'allume avant celle de droite."),
    "de": ("Zuerst wird das Einlassventil geschlossen, dann öffnet man den Abfluss.", "Die linke Lampe leuchtet vor der rechten auf."),
}
# Lead-ins before an echoed question.
LEAD_INS = frozenset(normalise(x) for x in ("", "答", "问", "问题", "question", "q", "a", "answer", "您问的是", "你问的是", "you asked", "the question is", "your question", "the question", "回答", "您的问题是", "重复一下"))
# Common words by which Latin-script languages differ.
COMMON_WORDS = {
    "en": frozenset("the of to and is a in that it for on as with was be by at an are or from this not but if when may shall must no has have its which you your".split()),
    "es": frozenset("el la los las de que y en un una es se por con para del al lo su pero sin si más muy no hay como nadie siempre".split()),
    "fr": frozenset("le la les des de un une et est en que qui dans pour sur avec au aux du ce se ne pas plus on toujours avant son".split()),
    "de": frozenset("der die das und ist in den von zu mit für auf ein eine nicht dem des im es sich als auch man vor".split()),
}
_REQUEST = re.compile(r"(?:用|以|译成|翻译成)\s*(英|中|汉|日|法|德|西)(?:文|语|班牙)|\b(?:in|into)\s+(English|Chinese|Japanese|French|German|Spanish)\b", re.IGNORECASE)
_REQUESTED = {"英": "en", "中": "zh", "汉": "zh", "日": "ja", "法": "fr", "德": "de", "西": "es", "english": "en", "chinese": "zh", "japanese": "ja", "french": "fr", "german": "de", "spanish": "es"}
_HAN, _KANA, _HANGUL, _LATIN = re.compile(r"[㐀-鿿]"), re.compile(r"[぀-ヿ]"), re.compile(r"[가-힣]"), re.compile(r"[^\W\d_]+")
_LATIN_RUN = re.compile(r"[A-Za-zÀ-ɏ]+(?:'[a-z]+)?")
_CLAUSE = re.compile(r"[^.!?。！？\n]+(?:[.](?=\w)[^.!?。！？\n]*)*[.!?。！？]*|[.!?。！？]+")


def _kinds(text: str) -> tuple[int, int, int, list[str]]:
    """Kana, Han and Hangul characters of a text, and its words in Latin script."""
    words = _LATIN_RUN.findall(text)
    return (0, 0, 0, words) if text.isascii() else (len(_KANA.findall(text)), len(_HAN.findall(text)), len(_HANGUL.findall(text)), words)


def _language(kinds: tuple[int, int, int, list[str]]) -> str:
    kana, han, hangul, words = kinds
    if kana and kana >= 0.15 * (kana + han) and kana + han >= len(words):
        return "ja"
    if hangul > han and hangul > len(words):
        return "ko"
    # one word says about as much as two characters
    if han and han >= 1.2 * len(words):
        return "zh"
    if not words:
        return ""
    low = [w.lower() for w in words]
    scores = {k: sum(map(common.__contains__, low)) for k, common in COMMON_WORDS.items()}
    best = max(scores, key=lambda k: (scores[k], k == "en"))
    return best if scores[best] > scores["en"] else "en"


def language(text: str) -> str:
    """zh, ja, ko, a Latin-script language of COMMON_WORDS, or '' where there is nothing to tell."""
    return _language(_kinds(text))


def _script(kinds: tuple[int, int, int, list[str]]) -> str:
    kana, han, _, words = kinds
    if not kana + han + len(words):
        return ""
    return "kana" if kana > 0.15 * (kana + han) and kana + han >= len(words) else "han" if han >= len(words) else "latin"


# named features of a clause; hashed n-grams follow after NAMED
(F_BIAS, F_FIRST, F_LAST, F_ALONE, F_SHORT, F_FOREIGN, F_NEUTRAL, F_SCRIPT, F_REASON, F_OBJECT, F_SAID, F_HELD) = range(12)
_OWN, _HELD, _END = 12, 18, 24  # from there on: bins of the clause's share in the question, of the question's share in the clause, of the end
NAMED, GRAM_BITS = 32, 15
N_FEATURES = NAMED + (1 << GRAM_BITS)


def clauses_of(body: str) -> list[str]:
    """Clauses of a text, in order; blank ones are left out."""
    return [c for c in (m[0].strip() for m in _CLAUSE.finditer(body)) if c]


def _grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, starts, scale) of the 2- and 3-character n-grams of normalised clauses, in the clauses'
    order. A mark stands on either side of a clause, so that n-grams at its edges are features of their own.
    """
    cp = np.frombuffer(("\x00" + "\x00".join(parts) + "\x00\x00").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    h2 = cp[:-2] * np.uint32(0x9E3779B1)
    h2 = (h2 ^ (h2 >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[1:-1] * np.uint32(0xC2B2AE35)
    h3 = (h2 ^ (h2 >> np.uint32(13))) * np.uint32(0x27D4EB2F) + cp[2:] * np.uint32(0xC2B2AE3D)
    both = np.empty(2 * len(h2), dtype=np.uint32)  # the n-grams that begin at one place side by side
    both[::2], both[1::2] = h2, h3
    # a clause of n characters has n + 1 places, the mark before it the first
    starts = np.zeros(len(parts), dtype=np.int64)
    np.cumsum(size[:-1], out=starts[1:])
    feature = ((both ^ (both >> np.uint32(16))) >> np.uint32(32 - GRAM_BITS)).astype(np.int64) + NAMED
    return feature[: 2 * int(size.sum())], 2 * starts, 1.0 / np.sqrt(np.maximum(8, 2 * size))


class Sequence:
    """The clauses of a reply as the field reads them: named features and n-grams of each, and its letters."""

    __slots__ = ("clauses", "named", "named_at", "grams", "starts", "scale", "letters", "foreign")

    def __init__(self, reply: Reply, question: str, odds: Callable[[str], float], body: str | None = None):
        reason = body is not None  # the text is the reason why there is no answer
        body = reply.body if body is None else body
        self.clauses = parts = clauses_of(body)
        norms = [normalise(c) for c in parts]
        self.letters = [max(1, len(n)) for n in norms]
        kinds = _kinds(question)
        asked, script = _language(kinds), _script(kinds)
        nq = normalise(question)
        grams = {nq[i : i + 3] for i in range(len(nq) - 2)}
        kinds = _kinds(body)
        whole, whole_script = _language(kinds), _script(kinds)
        mixed = bool(kinds[0] or kinds[1]) and bool(kinds[3])
        wanted = {asked} | {_REQUESTED[(a or b).lower()] for a, b in _REQUEST.findall(question)}
        self.named, self.named_at, self.foreign = [], [], []
        for i, (c, n) in enumerate(zip(parts, norms)):
            self.named_at.append(len(self.named))
            f = [F_BIAS]
            if i == 0:
                f.append(F_FIRST)
            if len(parts) == 1:
                f.append(F_ALONE)
            if len(n) <= 4:
                f.append(F_SHORT)
            spoken, written = whole, whole_script
            if mixed:
                kinds = _kinds(c)
                spoken, written = _language(kinds), _script(kinds)
            strange = bool(asked and spoken and spoken not in wanted and len(n) >= 4 and sum(map(str.isalpha, n)) >= 4)
            self.foreign.append(strange)
            if strange:
                f.append(F_FOREIGN)
            elif not spoken:
                f.append(F_NEUTRAL)
            if len(wanted) == 1 and script and written not in ("", script):
                f.append(F_SCRIPT)
            if reason:
                f.append(F_REASON)
            if len(nq) >= 4 and len(n) >= 3:
                own = {n[j : j + 3] for j in range(len(n) - 2)}
                shared = len(own & grams)
                f.append(_OWN + 5 * shared // len(own))
                f.append(_HELD + 5 * shared // max(1, len(grams)))
                if shared == len(own) and n in nq:
                    f.append(F_HELD)
                if shared == len(grams) and nq in n:
                    f.append(F_SAID)
            if i == len(parts) - 1 and not reason:
                f.append(F_LAST)
                if reply.broken_object:
                    f.append(F_OBJECT)
                if reply.state == BROKEN:
                    f.append(_END)
                elif reply.state == OPEN and n not in PLACEHOLDERS:
                    f.append(_END + 1 + int(min(6, max(0, odds(reply.body) + 3))))
            self.named.extend(f)
        self.grams, self.starts, self.scale = _grams(norms) if parts else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))

    def scores(self, emit: np.ndarray) -> np.ndarray:
        """clauses x tags"""
        return np.add.reduceat(emit[self.named], self.named_at, axis=0) + np.add.reduceat(emit[self.grams], self.starts, axis=0) * self.scale[:, None]

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(clause, feature, value) of all features."""
        n = len(self.clauses)
        many, more = np.diff([*self.named_at, len(self.named)]), np.diff([*self.starts, len(self.grams)])
        at = np.concatenate([np.repeat(np.arange(n), many), np.repeat(np.arange(n), more)])
        return at, np.concatenate([np.array(self.named, dtype=np.int64), self.grams]), np.concatenate([np.ones(len(self.named)), np.repeat(self.scale, more)])


class Field:
    """A linear-chain conditional random field; ``emit`` is features x tags, ``move`` tags x tags."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        k = len(TAGS)
        self.emit = np.zeros((N_FEATURES, k)) if emit is None else emit
        self.move = np.zeros((k, k)) if move is None else move

    def fit(self, seqs: list[Sequence], tags: list[list[int]], steps: int = 80, l2: float = 2e-4) -> "Field":
        """Maximum likelihood by forward-backward and Adam."""
        k, n = len(TAGS), len(seqs)
        order = sorted(range(n), key=lambda i: -len(seqs[i].clauses))  # longest first: at each place the first few go on
        seqs, tags = [seqs[i] for i in order], [tags[i] for i in order]
        lens = np.array([len(s.clauses) for s in seqs])
        longest = int(lens[0])
        active = [int((lens > t).sum()) for t in range(longest)]
        first = np.concatenate([[0], np.cumsum(active)])  # cells are kept place by place
        read = [s.triples() for s in seqs]
        at = np.concatenate([first[a] + i for i, (a, _, _) in enumerate(read)])
        feature, value = np.concatenate([x for _, x, _ in read]), np.concatenate([x for _, _, x in read])
        used, feature = np.unique(feature, return_inverse=True)
        cells = int(first[-1])
        gold = np.zeros((cells, k))
        gold_move = np.zeros((k, k))
        for i, t in enumerate(tags):
            gold[first[: len(t)] + i, t] = 1.0
            np.add.at(gold_move, (t[:-1], t[1:]), 1.0)
        theta = [self.emit[used].copy(), self.move]
        m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        last = first[lens - 1] + np.arange(n)
        for step in range(1, steps + 1):
            score = np.stack([np.bincount(at, theta[0][feature, j] * value, cells) for j in range(k)], axis=1)
            alpha, beta = score.copy(), np.zeros((cells, k))
            for t in range(1, longest):
                here, a = slice(first[t], first[t + 1]), alpha[first[t - 1] : first[t - 1] + active[t], :, None] + self.move
                top = a.max(1)
                alpha[here] += top + np.log(np.exp(a - top[:, None]).sum(1))
            for t in range(longest - 2, -1, -1):
                on = slice(first[t + 1], first[t + 2])
                b = self.move + (score[on] + beta[on])[:, None]
                top = b.max(2)
                beta[first[t] : first[t] + active[t + 1]] = top + np.log(np.exp(b - top[..., None]).sum(2))
            end = alpha[last]
            top = end.max(1)
            log_z = top + np.log(np.exp(end - top[:, None]).sum(1))
            of = np.concatenate([np.arange(c) for c in active])
            mean = np.exp(np.minimum(0.0, alpha + beta - log_z[of, None]))
            pair = np.zeros((k, k))
            for t in range(1, longest):
                on, c = slice(first[t], first[t + 1]), active[t]
                p = alpha[first[t - 1] : first[t - 1] + c, :, None] + self.move + (score[on] + beta[on])[:, None] - log_z[:c, None, None]
                pair += np.exp(np.minimum(0.0, p)).sum(0)
            off = mean - gold
            grads = [np.stack([np.bincount(feature, off[at, j] * value, len(used)) for j in range(k)], axis=1) / n + l2 * theta[0], (pair - gold_move) / n + l2 * self.move]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                theta[i] -= 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.emit[used] = theta[0]
        return self

    def tag(self, seq: Sequence) -> list[int]:
        return _viterbi(seq.scores(self.emit), self.move)


def _viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    best, back = scores[0], []
    for e in scores[1:]:
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + e
    tags = [int(best.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def training_sequences(pairs: list[tuple[str, str]], odds: Callable[[str], float], declines: list[str] = (), reasons: list[str] = (), seed: int = 7) -> tuple[list[Sequence], list[list[int]]]:
    """Sequences with their tags, made of sound (question, reply) pairs by spoiling them.

    ``declines`` are further clauses that decline, ``reasons`` texts given for want of an answer.
    """
    rng = random.Random(seed)
    built = [
        ("水箱满了以后应该先关哪个阀门？", "先关进水阀。再打开排水阀，等水位降到刻度以下。最后记录时间。"),
        ("Which valve is closed first when the tank is full?", "Close the inlet valve first. Then open the drain and wait until the level falls. Note the time at the end."),
        ("请说明两盏灯的先后。", "左灯先亮。右灯在三秒之后亮。"),
        ("How do the two lamps follow each other?", "The left lamp lights up first. The right lamp follows after three seconds."),
        ("出发前要带什么？", "不需要。"),
        ("May the visitor enter alone?", "Yes."),
    ] * 3
    sound = [(q, a) for q, a in [*built, *pairs] if a and q]
    spoiled = sound[: len(built) + FIT_REPLIES]
    by_lang: dict[str, list[str]] = {k: list(v) for k, v in STRANGE.items()}
    for q, a in spoiled:
        by_lang.setdefault(language(a), []).append(a)
    languages = sorted(k for k in by_lang if k)
    told: dict[str, list[str]] = {}
    for text in reasons:
        told.setdefault(language(text), []).append(text)
    ways = {k: list(v) for k, v in REFUSALS.items()}
    for text in declines:
        ways.setdefault(language(text) or "en", []).append(text)
    seqs, tags = [], []

    def add(q: str, text: str, tag, body: str | None = None) -> None:
        s = Sequence(Reply(text), q, odds, body)
        if s.clauses:
            seqs.append(s)
            tags.append([tag(i, c, s) for i, c in enumerate(s.clauses)])

    refuse = lambda i, c, s: REFUSAL
    echo = lambda i, c, s: ECHO
    for q, a in sound[len(spoiled) :]:
        add(q, a, lambda i, c, s: ANSWER)
    for q, a in spoiled:
        lang = language(q) or "en"
        nq = normalise(q)
        add(q, a, lambda i, c, s: ANSWER)
        whole = clauses_of(a)
        cut = a[: max(4, int(len(a) * rng.uniform(0.2, 0.98)))].rstrip()
        if Reply(cut).state != CLOSED and odds(cut) > 0:
            add(q, cut, lambda i, c, s: UNFINISHED if i == len(s.clauses) - 1 else ANSWER)
        if Reply(broken := cut + rng.choice(("\ufffd", "…"))).state == BROKEN:
            add(q, broken, lambda i, c, s: UNFINISHED if i == len(s.clauses) - 1 else ANSWER)
        open_object = '{"answer": "' + cut.replace('"', "'").replace("\n", "\\n")
        if Reply(open_object).broken_object:
            add(q, open_object, lambda i, c, s: UNFINISHED if i == len(s.clauses) - 1 else ANSWER)
        own = ways.get(lang) or ways["en"]
        add(q, rng.choice(own), refuse)
        add(q, f"{rng.choice(own)} {rng.choice(own)}", refuse)
        if lang in told:
            add(q, "{}", refuse, rng.choice(told[lang]))
        add(q, "{}", refuse, rng.choice(own))
        for lead in ("", rng.choice(("答：", "A: ", "> ", "You asked: "))):
            add(q, lead + q, echo)
        add(q, f"{q}\n{a}", lambda i, c, s: ECHO if normalise(c) and normalise(c) in nq else ANSWER)
        for other in rng.sample([k for k in languages if k != lang], 2):
            text = rng.choice(by_lang[other])
            for part in (text, clauses_of(text)[0]):
                add(q, part, lambda i, c, s: FOREIGN if s.foreign[i] else ANSWER)
        if len(whole) > 1 and whole[-1][-1:] in ".。":
            add(q, clauses_of(a)[0], lambda i, c, s: ANSWER)
    return seqs, tags


def mined_declines(may: list[str], must: list[str]) -> list[str]:
    """First clauses that replies to rows that may decline share, and that other replies hardly hold.

    ``may`` and ``must`` are answer texts; a clause counts by what it says without numbers.
    """
    plain = lambda x: re.sub(r"\d+", "0", normalise(x))
    head = lambda texts: [(plain(c[0]), c[0]) for c in map(clauses_of, texts) if c]
    here, there = head(may), Counter(k for k, _ in head(must))
    said = Counter(k for k, _ in here)
    text = dict(reversed(here))
    rate = lambda n, of: n / max(1, len(of))
    return [text[k] for k, n in sorted(said.items()) if n >= 8 and len(k) >= 5 and rate(n, may) >= 6 * rate(there[k] + 1, must)]


def fit_field(rows: DataFrame, keys: list[str], prompt: str, reply: str, may_refuse: str, odds: Callable[[str], float]) -> Field:
    """The field from at most 5 x FIT_REPLIES sound replies, and the ways to decline of at most FIT_ROWS
    rows of either kind, picked by a hash of their keys.

    The cut-off hash is found from the keys alone, inside the cluster; then the few rows under it
    are read. Repeated keys cannot make the sample larger than its bound.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*keys)).withColumn("__m", F.coalesce(F.col(may_refuse), F.lit(False)))
    taken = []
    for kind in (True, False):
        part = hashed.where(F.col("__m") == kind)
        cut = part.select("__h").orderBy("__h").limit(FIT_ROWS).agg(F.max("__h")).first()[0]
        if cut is not None:
            taken.append(part.where(F.col("__h") <= F.lit(cut)).select("__m", F.col(prompt).alias("q"), F.col(reply).alias("a")).where("a is not null").limit(2 * FIT_ROWS))
    sample = [r for part in taken for r in part.collect()]
    sample.sort(key=lambda r: (r["a"], r["q"] or ""))
    random.Random(5).shuffle(sample)
    read = [(r["__m"], question_of(r["q"]), Reply(r["a"])) for r in sample]
    reasons = sorted({x.found["cannot_answer_reason"] for _, _, x in read if x.found and isinstance(x.found.get("cannot_answer_reason"), str) and normalise(x.found["cannot_answer_reason"])})
    plain = lambda kind: [x.body for m, _, x in read if m == kind and normalise(x.body) and not x.broken_object]
    declines = mined_declines(plain(True), plain(False))
    known = {re.sub(r"\d+", "0", normalise(x)) for x in (*declines, *(w for ws in REFUSALS.values() for w in ws))}
    pairs = []
    for may, q, x in read:
        c = clauses_of(x.body)
        if not may and q and c and x.state != BROKEN and (x.state == CLOSED or odds(x.body) < 0) and language(x.body) in ("", language(q)) and normalise(q) not in normalise(x.body) and not known & {re.sub(r"\d+", "0", normalise(k)) for k in c}:
            pairs.append((q, x.body))
    return Field().fit(*training_sequences(pairs[: 5 * FIT_REPLIES], odds, declines, reasons))


def reply_defect(reply: str | None, question: str, may_refuse: bool, field: Field, odds: Callable[[str], float]) -> str | None:
    """The defect of one reply: empty, truncated, refusal, copied, language, or None.

    A reply is ``empty`` where no clause says anything; the other defects follow from the share of
    the letters under each tag, ``truncated`` from the tag of the last clause.
    """
    if reply is None:
        return "empty"
    r = Reply(reply)
    body = None
    if r.found is not None:
        answer, reason = r.found.get("answer"), r.found.get("cannot_answer_reason")
        nothing = not r.found or "answer" in r.found and (answer is None or isinstance(answer, str) and not normalise(answer))
        if (nothing or not isinstance(answer, str)) and isinstance(reason, str) and reason.strip():
            body = reason
        elif nothing:
            return "empty"
    if body is None and r.found is None and not r.broken_object and (not (said := normalise(r.body)) or said in PLACEHOLDERS):
        return "empty"
    seq = Sequence(r, question, odds, body)
    if not seq.clauses:
        return "truncated" if r.broken_object else "empty"
    tags = field.tag(seq)
    total = sum(seq.letters)
    share = [0.0] * len(TAGS)
    for t, n in zip(tags, seq.letters):
        share[t] += n / total
    if tags[-1] == UNFINISHED and r.state != CLOSED and body is None:
        return "truncated"
    if share[REFUSAL] >= 0.5:
        return None if may_refuse else "refusal"
    if share[ECHO] >= 0.5:
        nq, said = normalise(question), normalise(r.body if body is None else body)
        if nq and said.endswith(nq) and said[: -len(nq)] in LEAD_INS:  # an exact check: nothing but the question
            return "copied"
    if share[FOREIGN] >= 0.5:
        return "language"
    return None


def broken_replies(df: DataFrame, keys: list[str], prompt: str, reply: str, may_refuse: str, by: tuple[str, ...] = ()) -> DataFrame:
    """keys and defect of every defective reply.

    A null or blank reply is ``empty``; a null prompt has no language and cannot be echoed; equal
    rows each give a row; an empty table gives none; texts of any length are read whole; other
    columns are ignored. ``by`` names the columns whose values may have length limits of their own.
    The endings are measured in one pass and the replies tagged in another, without a shuffle of texts.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys([*keys, *by]))
    measured = write_shared(truncation.measure(df.select(*names, F.col(prompt).alias("__q"), F.col(reply).alias("__a")), names, "__a", "__q"))
    model = truncation.ending_model(measured, list(by))
    field = fit_field(df, keys, prompt, reply, may_refuse, model.cut)
    shared = spark.sparkContext.broadcast((field.emit.astype(np.float32), field.move, model.weights, model.bias, model.common))  # of fixed size
    flat = df.select(*keys, F.col(prompt).alias("__q"), F.col(reply).alias("__a"), F.coalesce(F.col(may_refuse), F.lit(False)).alias("__m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emit, move, *rest = shared.value
        field, odds = Field(emit, move), Endings(*rest).cut
        for b in batches:
            found = [reply_defect(a, question_of(q).strip(), m, field, odds) for q, a, m in zip(b["__q"], b["__a"], b["__m"])]
            out = b[keys].copy()
            out["defect"] = found
            yield out[out["defect"].notna()]

    return flat.mapInPandas(run, flat.select(*keys).schema.add("defect", "string"))
