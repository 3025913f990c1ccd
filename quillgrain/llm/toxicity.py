"""Abusive, hateful and sexual content: a chain of linear classifiers over sentences.

The reviewed sample labels whole documents; one sentence makes a document abusive. Training
therefore picks the sentences of abusive documents that carry the label (seed words and rarity
first, then models that did not see the document). Negatives are sentences of clean labelled
documents and, as background, of documents nobody labelled, all picked by a hash over all of them;
the highest-scoring come back as hard negatives. The chain predicts sexual, threat, hate, insult and
at last the reviewed label; each later model sees the earlier probabilities, in training the
out-of-fold ones. Seed words only start the categories: sentences without any get theirs from
out-of-fold models and teach the next round. The score from which a document counts as abusive
follows from out-of-fold scores too. Features are hashed character n-grams of two streams: the text
as it is, and its letters with look-alikes folded, in which spaced-out and starred words read as
plain ones.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that start the categories; the models learn the rest from the labels.
SEEDS = {
    "sexual": "naked nude nudes tits breasts fuck screw moaned horny panties whore escort hooker legs cum porn 裸 奶子 乳房 内裤 底裤 裤裆 屁股 骚 高潮 喷了 射了 口交 做爱 约炮 床上 脱光 活好",
    "threat": "kill slit smash strangle stab burn you die hunt 弄死 打断 掐死 扇烂 砍死 杀了 打死 抽你 横着出去 跪下 等着",
    "hate": "vermin parasites subhuman savages deserve breeding immigrants foreigners migrants gays beggars peasants 外地佬 乡巴佬 残废 同性恋 娘娘腔 移民 穷鬼 天生就 不配上桌 都该 祸害子孙 骗子胚 绝种",
    "insult": "idiot moron bitch bastard turd stupid worthless pathetic scum filth cow useless ugly 傻逼 废物 垃圾 贱货 贱人 狗东西 王八蛋 畜生 蠢猪 脑瘫 杂种 混蛋 白痴 臭嘴 滚蛋 货色 浪费粮食 死全家 去死",
}
CHAIN = ("sexual", "threat", "hate", "insult", "toxic")
BITS = 18
_SIZE = 1 << BITS
#: Most labelled documents that are used, abusive and clean, and about how many documents give the
#: background; the documented bounds of the fit.
MAX_ABUSIVE, MAX_CLEAN, BACKGROUND = 2000, 5000, 1500
#: Most sentences the fit takes from a document (picked by a hash), and most characters of a sentence in it.
FROM_EACH, FIT_CHARS = 60, 400
#: With fewer abusive documents the labels say too little about the threshold, and the cautious one holds.
FEW_LABELS, CAUTIOUS = 10, 0.9
#: A sentence of at most SHORT characters, its mark included, is read together with its neighbour.
SHORT = 3
#: Marks and numbers with fewer n-grams say nothing; a sentence with few has its sum shrunk as if it had FEW_GRAMS.
LEAST_GRAMS, FEW_GRAMS = 6, 50.0
#: From so many sentences of labelled documents on, the seed words themselves are no cases any more.
ENOUGH = 60
#: Names of HTML tags; other text between angle brackets is text.
_TAG = re.compile(r"</?(?:a|abbr|article|b|blockquote|body|br|button|center|code|dd|div|dl|dt|em|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|label|li|link|main|meta|nav|ol|option|p|pre|script|section|select|small|span|strong|style|sub|sup|table|tbody|td|textarea|tfoot|th|thead|title|tr|u|ul|video)\b(?:\s[^<>\x00]{0,200})?/?>")
_BLANK = re.compile(r"[^\S\n\x00]+")
_FOLD = {"1": "i", "0": "o", "3": "e", "@": "a", "$": "s"}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x10000: is it kept in the letters stream, and as what."""
    keep = np.fromiter((chr(c).isalnum() for c in range(0x10000)), dtype=bool, count=0x10000)
    fold = np.arange(0x10000, dtype=np.uint32)
    for a, b in _FOLD.items():
        keep[ord(a)], fold[ord(a)] = True, ord(b)
    return keep, fold


def _letters(cp: np.ndarray) -> np.ndarray:
    """Which code points of lower-case text are letters, not marks, blanks or digits, near enough."""
    return (cp >= 0x61) & ((cp < 0x7B) | (cp > 0xBF)) & ((cp < 0x2000) | (cp > 0x206F)) & ((cp < 0x3000) | (cp > 0x303F))


def _join_short(cp: np.ndarray, sent: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sentence numbers in which a short sentence with letters belongs to the sentence with letters before
    it, or else after it, in the same text."""
    size = np.bincount(sent)
    said = np.flatnonzero(np.bincount(sent, weights=_letters(cp)) > 0)
    short = np.flatnonzero(size[said] <= SHORT)
    if not len(short):
        return sent
    of = doc[np.cumsum(size)[said] - 1]
    back = (short > 0) & (of[short - 1] == of[short])
    on = ~back & (short + 1 < len(said)) & (of[np.minimum(short + 1, len(said) - 1)] == of[short])
    open_ = np.zeros(len(size) + 1, dtype=np.int32)
    np.add.at(open_, said[np.where(back, short - 1, short)[back | on]], 1)
    np.add.at(open_, said[np.where(on, short + 1, short)[back | on]], -1)
    number = np.zeros(len(size), dtype=np.int32)
    np.cumsum(np.cumsum(open_)[: len(size) - 1] == 0, out=number[1:])
    return number[sent]


def _stream(texts: list[str], join: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the sentence number of each, and the text number of each sentence.

    With ``join`` a short sentence counts to its neighbour. The fit reads short ones alone,
    or else shortness would be a cue where labels are few.
    """
    body = "\x00".join(t.replace("\x00", " ") if t else "" for t in texts) + "\x00"
    body = _BLANK.sub(" ", _TAG.sub(" ", unicodedata.normalize("NFKC", body).lower()))
    cp = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    end = (cp == 0) | (cp == 10) | (cp == ord("。")) | (cp == ord("!")) | (cp == ord("?"))
    dot = cp == ord(".")
    dot[:-1] &= np.isin(cp[1:], np.array([32, 10, 0], dtype=np.uint32))
    end |= dot
    sent = np.zeros(len(cp), dtype=np.int32)
    np.cumsum(end[:-1], out=sent[1:])
    doc = np.zeros(len(cp), dtype=np.int32)
    np.cumsum((cp == 0)[:-1], out=doc[1:])
    if join:
        sent = _join_short(cp, sent, doc)
    first = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]]))
    return cp, sent, doc[first]


def _grams(cp: np.ndarray, sent: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sentence of each n-gram, its feature); an n-gram across sentences has feature ``_SIZE``."""
    keep, fold = tables
    low = np.minimum(cp, 0xFFFF)
    kept = keep[low] | (cp > 0xFFFF)
    for which, (c, s) in enumerate(((cp, sent), (np.where(cp[kept] > 0xFFFF, cp[kept], fold[low[kept]]), sent[kept]))):
        c = c.astype(np.uint32)
        h = c * np.uint32(0x9E3779B1)
        for n in range(2, 6 if which == 0 else 5):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0xC2B2AE35 + 2 * n)
            x = ((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F + 16 * which)) >> np.uint32(32 - BITS)
            yield s[: len(x)], np.where(s[: len(x)] == s[n - 1 :], x, np.uint32(_SIZE))


class Sentences:
    """Sparse features of a list of sentences (each is one unit, whatever marks it holds)."""

    def __init__(self, texts: list[str], tables: tuple[np.ndarray, np.ndarray]):
        cp, sent, doc = _stream(texts)
        unit = doc[sent].astype(np.int32)
        rows, cols = [], []
        for s, x in _grams(cp, unit, tables):
            ok = x < _SIZE
            rows.append(s[ok])
            cols.append(x[ok].astype(np.int32))
        self.rows, self.cols, self.n = np.concatenate(rows), np.concatenate(cols), len(texts)
        self.norm = 1.0 / np.sqrt(np.maximum(FEW_GRAMS, np.bincount(self.rows, minlength=self.n)[: self.n]))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows renumbered, cols) of the chosen sentences."""
        place = np.full(self.n + 1, -1, dtype=np.int32)
        place[which] = np.arange(len(which))
        r = place[self.rows]
        ok = r >= 0
        return r[ok], self.cols[ok]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fit_one(rows, cols, norm, extra, y, steps: int = 30, l2: float = 1e-4):
    """Logistic regression by Adam over sparse unit-length rows and a few dense columns."""
    n, d = len(y), extra.shape[1]
    pos = max(1.0, y.sum())
    weight = np.where(y > 0, 0.5 * n / pos, 0.5 * n / max(1.0, n - pos)) ** 0.5
    weight /= weight.sum()
    used = np.flatnonzero(np.bincount(cols, minlength=_SIZE))
    place = np.zeros(_SIZE, dtype=np.int32)
    place[used] = np.arange(len(used))
    cols = place[cols]
    w = np.zeros(len(used) + d + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) * norm + extra @ w[len(used) : -1] + w[-1]
        e = (_sigmoid(z) - y) * weight
        g = np.concatenate([np.bincount(cols, weights=(e * norm)[rows], minlength=len(used)), extra.T @ e, [e.sum()]]) + l2 * w / max(1, n) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(_SIZE + 1, dtype=np.float32)
    full[used] = w[: len(used)]
    return full, w[len(used) : -1], w[-1]


def _sentences_of(text: str) -> list[str]:
    cp, sent, _ = _stream([text], join=False)
    cuts = np.flatnonzero(np.diff(sent)) + 1
    chars = "".join(map(chr, cp.tolist()))
    parts = [chars[a:z].strip("\x00 \n") for a, z in zip([0, *cuts], [*cuts, len(chars)])]
    return [p for p in parts if len(p) > 1]


class ToxicChain:
    """Weights of the chain; ``weights`` has a column for each category and a zero last row."""

    def __init__(self):
        self.weights = np.zeros((_SIZE + 1, len(CHAIN)), dtype=np.float32)
        self.bias = np.zeros(len(CHAIN))
        self.links = np.zeros((len(CHAIN), len(CHAIN)))
        self.threshold = CAUTIOUS

    def chain(self, sums: np.ndarray, norm: np.ndarray) -> np.ndarray:
        p = np.zeros((len(sums), len(CHAIN)))
        for k in range(len(CHAIN)):
            p[:, k] = _sigmoid(sums[:, k] * norm + p[:, :k] @ self.links[k, :k] + self.bias[k])
        return p

    def score(self, texts: list[str], tables) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every sentence, and the text of each sentence."""
        cp, sent, doc = _stream(texts)
        n = len(doc)
        sums, count = np.zeros((n, len(CHAIN)), dtype=np.float32), np.zeros(n)
        for s, x in _grams(cp, sent, tables):
            if not len(s):
                continue
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sums[s[starts]] += np.add.reduceat(self.weights[x], starts, axis=0)
            count[s[starts]] += np.add.reduceat((x < _SIZE).astype(np.int32), starts)
        p = self.chain(sums, 1.0 / np.sqrt(np.maximum(FEW_GRAMS, count)))
        p[(count < LEAST_GRAMS) & (np.bincount(sent, weights=_letters(cp), minlength=n) == 0)] = 0.0
        return p, doc


def _pick(scores: np.ndarray, docs: np.ndarray, least: float) -> np.ndarray:
    """Sentences over 0.5, and the best of each document that has none, if it reaches ``least``."""
    chosen = scores >= 0.5
    order = np.lexsort((-scores, docs))
    first = order[np.concatenate([[True], docs[order][1:] != docs[order][:-1]])] if len(order) else order
    covered = np.zeros(docs.max() + 1 if len(docs) else 0, dtype=bool)
    covered[docs[chosen]] = True
    for i in first:
        if not covered[docs[i]] and scores[i] >= least:
            chosen[i] = True
    return np.flatnonzero(chosen)


def _by_hash(pool: list[str]) -> list[str]:
    """The sentences in the order of a hash of place and text, so that any first part is spread over all."""
    return [s for _, _, s in sorted((hashlib.blake2b(f"{i} {s}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), i, s) for i, s in enumerate(pool))]


def _highest(scored: list[tuple[float, str]], most: int) -> list[str]:
    """The sentences of the highest scores, at most so many."""
    return [s for _, s in sorted(scored, key=lambda x: (-x[0], x[1]))[:most]]


class _Fold:
    """Rows of a fit: features of sentences, and which fold each belongs to."""

    def __init__(self, rows, cols, norm, fold):
        self.rows, self.cols, self.norm, self.fold = rows, cols, norm, fold

    def fit(self, which: np.ndarray, extra: np.ndarray, y: np.ndarray):
        place = np.full(len(self.norm), -1)
        place[which] = np.arange(len(which))
        ok = place[self.rows] >= 0
        return _fit_one(place[self.rows[ok]], self.cols[ok], self.norm[which], extra[which], y[which])

    def predict(self, model, extra: np.ndarray) -> np.ndarray:
        w, v, b = model
        return _sigmoid(np.bincount(self.rows, weights=w[self.cols], minlength=len(self.norm)) * self.norm + extra @ v + b)


def _threshold(abusive: np.ndarray, clean: np.ndarray, each: float, share: float) -> float:
    """The score that promises the best F1: ``abusive`` are best scores of abusive documents, ``clean``
    scores of sentences of clean ones, of which a document has ``each``; ``share`` of documents is abusive.
    """
    if len(abusive) < FEW_LABELS:
        return CAUTIOUS
    grid = np.arange(0.5, 0.91, 0.02)
    hit = share * np.array([(abusive >= t).mean() for t in grid])
    false = (1 - share) * np.minimum(1.0, np.array([(clean >= t).mean() if len(clean) else 0.0 for t in grid]) * each)
    value = 2 * hit / np.maximum(hit + false + share, 1e-12)
    best = np.flatnonzero(value >= value.max() - 1e-9)
    return round(float(grid[best[len(best) // 2]]), 2)


def fit_chain(abusive: list[list[str]], clean: list[str], background: list[str] = (), each: float = 20.0, share: float | None = None, negatives: int = 5000, folds: int = 2) -> ToxicChain:
    """The chain from the sentences of each abusive document and of all clean ones.

    Without an abusive document only the seeds are known. ``each`` is how many sentences a document
    has, ``share`` how many of the labelled documents are abusive.
    """
    tables = _tables()
    model = ToxicChain()
    seeds = {c: [w.lower() for w in words.split()] for c, words in SEEDS.items()}
    cand = [s for d in abusive for s in d]
    cand_doc = [i for i, d in enumerate(abusive) for _ in d]
    pool = _by_hash(list(clean))
    easy = pool[:negatives]
    behind = _by_hash(list(background))[:negatives]
    neg = easy or ["ok"]

    # the seed words, so that no category is without a case; where they are all there is to learn
    # from, they are set into clean sentences, or else a short sentence would be a cue
    for i, w in enumerate(w for words in seeds.values() for w in words):
        host = pool[i * 37 % len(pool)] if pool and not abusive else ""
        cand.append(f"{host[: len(host) // 2]} {w} {host[len(host) // 2 :]}".strip())
        cand_doc.append(len(abusive))
    cand_doc = np.array(cand_doc)
    is_seed = cand_doc == len(abusive)
    finders = [re.compile("|".join(rf"\b{w}\b" if w.isascii() else re.escape(w) for w in words)) for words in seeds.values()]
    hits = np.array([[f.search(s) is not None for f in finders] for s in cand], dtype=bool)

    feats = Sentences(cand, tables)
    common = np.bincount(Sentences([*pool[:20000], *behind] or ["ok"], tables).cols, minlength=_SIZE) > 1
    rare = 1.0 - np.bincount(feats.rows, weights=common[feats.cols], minlength=feats.n) * feats.norm**2
    scores = np.minimum(1.0, rare * 0.8 + hits.any(1) * 0.35)
    scores[is_seed] = 1.0
    chosen = np.flatnonzero(is_seed | np.isin(np.arange(len(cand)), _pick(np.where(scores > 0.62, scores, scores * 0.5), cand_doc, 0.2)))
    every = _Fold(feats.rows, feats.cols, feats.norm, cand_doc % folds)

    for turn in range(3):
        final = turn == 2
        pos, n_pos, n = chosen, len(chosen), len(chosen) + len(neg)
        neg_f = Sentences(neg, tables)
        pr, pc = feats.take(pos)
        data = _Fold(np.concatenate([pr, neg_f.rows + n_pos]), np.concatenate([pc, neg_f.cols]), np.concatenate([feats.norm[pos], neg_f.norm]), np.concatenate([cand_doc[pos] % folds, np.arange(len(neg)) % folds]))
        y_toxic = np.concatenate([np.ones(n_pos), np.zeros(len(neg))])
        nothing = np.zeros((n, 0))
        if not final:
            # the choice among the abusive documents by models that did not see the document: a sentence
            # that no other document supports, as in a wrongly labelled one, is dropped
            p = np.zeros(feats.n)
            for f in range(folds):
                own = cand_doc % folds == f
                p[own] = every.predict(data.fit(np.flatnonzero(data.fold != f), nothing, y_toxic), np.zeros((feats.n, 0)))[own]
            whole = data.fit(np.arange(n), nothing, y_toxic)
            p[is_seed] = 1.0
            chosen = _pick(p, cand_doc, 0.3)
            if (~is_seed[chosen]).sum() >= ENOUGH:
                chosen = chosen[~is_seed[chosen]]  # bare words would teach that a short sentence is abusive
            hard: list[tuple[float, str]] = []
            for at in range(0, len(pool), 5000):
                part = pool[at : at + 5000]
                f = Sentences(part, tables)
                z = _sigmoid(np.bincount(f.rows, weights=whole[0][f.cols], minlength=f.n) * f.norm + whole[2])
                hard.extend((float(x), s) for s, x in zip(part, z) if x > 0.1 and len(s) > 2)
            # nobody reviewed the background: what looks abusive in it is no negative
            f = Sentences(behind or ["ok"], tables)
            z = _sigmoid(np.bincount(f.rows, weights=whole[0][f.cols], minlength=f.n) * f.norm + whole[2])
            behind = [s for s, x in zip(behind, z) if x < 0.3]
            neg = [*easy, *behind, *_highest(hard, 2 * negatives)] or ["ok"]
            continue

        # categories: the seed words first, then what models of the other documents make of the rest
        kinds = hits[pos].astype(float)
        sure = hits[pos].any(1)
        third = np.arange(len(neg)) % 3 == 0  # of the negatives a third is enough for a category
        for again in range(2):
            known = np.concatenate([sure, third])
            guess = np.zeros((n_pos, len(seeds)))
            for k in range(len(seeds)):
                y = np.concatenate([kinds[:, k], np.zeros(len(neg))])
                for f in range(folds):
                    held = data.fold[:n_pos] == f
                    guess[held, k] = data.predict(data.fit(np.flatnonzero(known & (data.fold != f)), nothing, y), nothing)[:n_pos][held]
            bare = ~hits[pos].any(1)
            kinds[bare] = guess[bare] >= 0.5
            sure = hits[pos].any(1) | (guess >= 0.5).any(1)
        known = np.concatenate([sure, third])
        oof, chain = np.zeros((n, len(CHAIN))), np.zeros((feats.n, len(CHAIN)))
        for k, name in enumerate(CHAIN):
            last = name == "toxic"
            y, use = (y_toxic, np.ones(n, dtype=bool)) if last else (np.concatenate([kinds[:, k], np.zeros(len(neg))]), known)
            for f in range(folds):
                part = data.fit(np.flatnonzero(use & (data.fold != f)), oof[:, :k], y)
                held, own = data.fold == f, cand_doc % folds == f
                oof[held, k] = data.predict(part, oof[:, :k])[held]
                chain[own, k] = every.predict(part, chain[:, :k])[own]
            w, v, b = data.fit(np.flatnonzero(use), oof[:, :k], y)
            model.weights[:, k], model.bias[k], model.links[k, :] = w, b, 0
            model.links[k, :k] = v
        best = np.zeros(len(abusive) + 1)
        np.maximum.at(best, cand_doc, chain[:, -1])
        model.threshold = _threshold(best[: len(abusive)], oof[n_pos : n_pos + len(easy), -1], each, share if share is not None else 0.5)
    return model


def labelled_sentences(docs: DataFrame, labels: DataFrame, key: str, text: str, flag: str) -> tuple[list[list[str]], list[str], list[str], float, float]:
    """Sentences of each abusive document, of the clean ones and of unlabelled ones; sentences in a
    document, and the share of labelled documents that are abusive.

    At most MAX_ABUSIVE and MAX_CLEAN labelled documents and about BACKGROUND others, picked by a hash
    of the key; at most FROM_EACH sentences of each, picked by a hash in the cluster. A document that
    reviewers disagree on is left out; null flags do not count.
    """
    one = labels.where(F.col(flag).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(flag).alias("a")).where("a = 0 or a = 1")
    ids = one.where("a = 1").orderBy(F.xxhash64("k"), "k").limit(MAX_ABUSIVE).unionByName(one.where("a = 0").orderBy(F.xxhash64("k"), "k").limit(MAX_CLEAN))
    flat = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    part = min(1.0, BACKGROUND / max(1, flat.count()))
    spread = (F.xxhash64("k", F.lit(11)) / F.lit(2.0**64)) + F.lit(0.5)
    rows = flat.join(F.broadcast(ids), "k", "left").where(F.col("a").isNotNull() | (spread < F.lit(part)))  # at most MAX_ABUSIVE + MAX_CLEAN keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, a in zip(b["k"], b["t"], b["a"]):
                own = _sentences_of(t)
                out.extend((str(k), a, s[:FIT_CHARS], len(own)) for s in _by_hash(own)[:FROM_EACH])
            yield pd.DataFrame(out, columns=["k", "a", "s", "n"])

    got = rows.mapInPandas(run, "k string, a double, s string, n int").toPandas().sort_values(["k", "s"], kind="stable")
    bad, good, rest = got[got["a"] == 1], got[got["a"] == 0], got[got["a"].isna()]
    docs_bad, docs_good = bad["k"].nunique(), good["k"].nunique()
    each = float(good.groupby("k")["n"].first().mean()) if docs_good else 20.0
    counts = one.groupBy("a").count().collect()  # two rows
    n = {r["a"]: r["count"] for r in counts}
    return [list(g) for _, g in bad.groupby("k")["s"]], good["s"].tolist(), rest["s"].tolist(), each, n.get(1.0, 0) / max(1, sum(n.values())) if docs_bad else 0.0


def score_documents(docs: DataFrame, labels: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), flag: str = "toxic", threshold: float | None = None) -> DataFrame:
    """Every document's highest sentence probability in each category.

    Columns: key, the ``keep`` columns, p_sexual, p_threat, p_hate, p_insult, score (the reviewed
    label's model) and abusive (score at or over ``threshold``, by default the one that out-of-fold scores
    promise the best F1 for, and CAUTIOUS where fewer than FEW_LABELS documents are labelled abusive).
    Null and empty texts score 0; equal rows score alike; labels may be empty (the seeds alone then
    teach the chain); other columns are ignored.
    """
    spark = docs.sparkSession
    fitted = fit_chain(*labelled_sentences(docs, labels, key, text, flag))
    threshold = fitted.threshold if threshold is None else threshold
    shared = spark.sparkContext.broadcast((fitted.weights, fitted.bias, fitted.links))  # of fixed size
    names = ["k", *[f"x{i}" for i in range(len(keep))]]
    flat = docs.select(F.col(key).alias("k"), *[F.col(c).alias(n) for c, n in zip(keep, names[1:])], F.col(text).alias("body"))
    made = flat.select(*names).schema
    for c in ("p_sexual", "p_threat", "p_hate", "p_insult", "score"):
        made = made.add(c, "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, chain = _tables(), ToxicChain()
        chain.weights, chain.bias, chain.links = shared.value
        for b in batches:
            part = b["body"].str.len().fillna(0).cumsum() // 400_000
            for _, rows in b.groupby(part):
                p, doc = chain.score(rows["body"].tolist(), tables)
                top = np.zeros((len(rows) + 1, len(CHAIN)))
                np.maximum.at(top, doc, p)
                top = top[: len(rows)]
                top[(rows["body"].isna() | (rows["body"] == "")).to_numpy()] = 0.0
                out = rows[names].copy()
                for c, v in zip(("p_sexual", "p_threat", "p_hate", "p_insult", "score"), top.T):
                    out[c] = np.round(v, 6)
                yield out

    out = flat.mapInPandas(run, made).withColumnsRenamed(dict(zip(names, [key, *keep])))
    return out.withColumn("abusive", F.col("score") >= F.lit(threshold))
