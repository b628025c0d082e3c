"""Toxicity by a support vector machine on sentences, over Nyström features of a gap-weighted subsequence kernel.

The kernel of two words compares letter subsequences with gaps, so a word spelled with gaps or inserted characters stays close to
the plain one; the kernel of two sentences is the sum over their pairs of words. Landmarks are words, so a sentence's Nyström features are
the sums of its words', and a linear machine on them gives a sentence the sum of a value for each word: each distinct word
is compared with the landmarks once. Labels are those of documents: the machine is trained on the sentences of a bounded sample of
labelled documents, those of toxic ones positive as far as the machine of the round before finds them so (at least the strongest
of each document), all sentences of the others negative. A document's score is a logistic of its sentences' decision values,
fitted on documents the machine has not seen.
"""

from __future__ import annotations

import re
import sys
import types
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package

#: Documented bounds of the training sample (documents of a label) and of the model.
TOXIC, OTHER, LANDMARKS = 1500, 3000, 96
ORDERS, DECAY, POWER = (2, 3), 0.85, 4
#: A word is compared with a landmark only if this share of the landmark's neighbouring letters follow each other in it, with up to
#: two letters between; else the kernel is taken as 0. Letters spelled with gaps or insertions pass.
GATE = 0.9
#: Smaller kernel values count as 0, so that most words add nothing to their sentence.
FAINT = 0.05
#: Longest instance; longer words become overlapping windows of it, of which the strongest counts.
WIDTH, STRIDE = 24, 12
#: Words of a sentence; longer ones are cut.
SENTENCE = 40
#: Weight of all made-up sentences of one landmark with an inserted letter, as a share of the sentences of toxic documents.
WORN = 0.3
#: Rounds of training; each takes anew which sentences of toxic documents are positive.
ROUNDS = 5
#: Words a worker remembers in each of two generations; more costs time and changes no score.
KEEP = 600_000
_EDGE = re.compile(r"[^\w]+|_+")
_END = re.compile(r"[.!?][^\w]*$")


def clean(raw: str) -> str:
    """A token without punctuation."""
    return raw if raw.isalnum() else _EDGE.sub("", raw)


def windows(w: str) -> list[str]:
    """A word as instances: itself, or overlapping windows of a very long one."""
    return [w] if len(w) <= WIDTH else list(dict.fromkeys(w[at : at + WIDTH] for at in range(0, len(w) - STRIDE, STRIDE)))


def ends_sentence(raw: str) -> bool:
    return not raw[-1].isalnum() and _END.search(raw) is not None


def sentences(ends: np.ndarray) -> np.ndarray:
    """A number for each token's sentence: they end after . ! or ?, and after SENTENCE tokens."""
    at = np.arange(len(ends))
    opens = np.concatenate([[True], ends[:-1]]) if len(ends) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(opens, at, 0))
    opens = opens | ((at - start) % SENTENCE == 0)
    return np.cumsum(opens) - 1


def spelled(tokens: list[str], single: np.ndarray) -> list[tuple[int, str]]:
    """(place of the last letter, word) of runs of at least three single letters."""
    if len(single) < 3 or not (single[:-2] & single[1:-1] & single[2:]).any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    return [(int(b) - 1, "".join(clean(t) for t in tokens[a:b])) for a, b in zip(edges[::2], edges[1::2]) if b - a > 2]


def _codes(words: list[str], pad: int) -> np.ndarray:
    """Code points, a word a row; words have no NUL, which fills the rows and becomes ``pad``."""
    if not words:
        return np.zeros((0, 0), np.int32)
    out = np.array(words, dtype=f"<U{max(1, *map(len, words))}").view("<i4").reshape(len(words), -1)
    out[out == 0] = pad
    return out


def _raw_kernels(a: np.ndarray, b: np.ndarray, paired: bool = False) -> list[np.ndarray]:
    """Gap-weighted subsequence kernels of each order up to the largest, of all pairs (or of a's rows with b's)."""
    shape = (len(a),) if paired else (len(a), len(b))
    l2 = np.float32(DECAY * DECAY)
    rows, cols = a.shape[1], b.shape[1]
    match = [[(a[:, i] == b[:, j]) if paired else (a[:, i, None] == b[None, :, j]) for j in range(cols)] for i in range(rows)]
    one = np.ones(shape, np.float32)
    prev = [[one] * (cols + 1) for _ in range(rows + 1)]
    zero = np.zeros(shape, np.float32)
    out = []
    top = max(ORDERS)
    for p in range(1, top + 1):
        k = np.zeros(shape, np.float32)
        cur = [[zero] * (cols + 1)]
        for i in range(1, rows + 1):
            row, run = [zero], zero
            for j in range(1, cols + 1):
                step = np.where(match[i - 1][j - 1], prev[i - 1][j - 1], 0) * l2
                k += step
                if p < top:
                    run = run * np.float32(DECAY) + step
                    row.append(cur[i - 1][j] * np.float32(DECAY) + run)
            cur.append(row)
        out.append(k)
        prev = cur
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel in [0, 1]: the mean over orders of K / sqrt(K K), to a power that sharpens it; each is a valid kernel."""
    if not a or not b:
        return np.zeros((len(a), len(b)), np.float32)
    ca, cb = _codes(a, -1), _codes(b, -2)
    both, sa, sb = _raw_kernels(ca, cb), _raw_kernels(ca, _codes(a, -2), True), _raw_kernels(_codes(b, -1), cb, True)
    total = np.zeros((len(a), len(b)), np.float32)
    for p in ORDERS:
        norm = np.sqrt(sa[p - 1][:, None] * sb[p - 1][None, :])
        total += np.where(norm > 0, both[p - 1] / np.where(norm > 0, norm, 1), 0)
    return (total / len(ORDERS)) ** POWER


class Landmarks:
    """The kernel of many words against fixed strings; only pairs that pass the gate are computed."""

    def __init__(self, marks: list[str]) -> None:
        self.marks = marks
        self.own = self._own(marks)
        self.pairs = [self._pairs([m], 1)[0] for m in marks]

    @staticmethod
    def _pairs(words: list[str], reach: int) -> np.ndarray:
        """Bit masks (256 bits a word) of the ordered letter pairs at most ``reach`` places apart; equal pairs share a bit."""
        out = np.zeros((len(words), 4), np.uint64)
        c = _codes(words, -1).astype(np.int64)
        rows = np.arange(len(words))
        for gap in range(1, reach + 1):
            for i in range(c.shape[1] - gap):
                x, y = c[:, i], c[:, i + gap]
                h = (x * 0x9E3779B1 + y * 0x85EBCA77) & 0xFFFFFFFF
                h ^= h >> 15
                bit = np.where(y >= 0, np.uint64(1) << (h & 63).astype(np.uint64), np.uint64(0))
                out[rows, (h >> 6) & 3] |= bit
        return out

    def gate(self, words: list[str]) -> np.ndarray:
        """Which landmarks each word is compared with; most words fail on the lane where a landmark has most of its pairs."""
        lanes, out = np.ascontiguousarray(self._pairs(words, 3).T), np.zeros((len(words), len(self.marks)), bool)
        for k, need in enumerate(self.pairs):
            bits = np.bitwise_count(need)
            first, least = int(bits.argmax()), max(1, int(np.ceil(GATE * bits.sum())))
            at = np.flatnonzero(np.bitwise_count(lanes[first] & need[first]) + int(bits.sum() - bits[first]) >= least)
            if len(at):
                out[at[np.bitwise_count(lanes[:, at] & need[:, None]).sum(axis=0) >= least], k] = True
        return out

    @staticmethod
    def _own(words: list[str]) -> np.ndarray:
        """Square roots of each word's kernel with itself, by order; batches of one length."""
        out = np.zeros((len(words), len(ORDERS)), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for rows in by.values():
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                c = _codes([words[i] for i in part], -1)
                k = _raw_kernels(c, c, True)
                out[part] = np.sqrt(np.stack([k[p - 1] for p in ORDERS], axis=1))
        return out

    def kernel(self, words: list[str], chunk: int = 4096) -> np.ndarray:
        out = np.zeros((len(words), len(self.marks)), np.float32)
        if not words or not self.marks:
            return out
        met = [np.argwhere(self.gate(words[at : at + 8192])) + [at, 0] for at in range(0, len(words), 8192)]
        pairs = np.concatenate(met)
        # pairs of like lengths are computed together, each word's own kernel once
        size = np.array([[len(words[i]), len(self.marks[k])] for i, k in pairs]).reshape(-1, 2)
        pairs = pairs[np.lexsort((size[:, 1], size[:, 0]))]
        hot, row = np.unique(pairs[:, 0], return_inverse=True)
        own = self._own([words[i] for i in hot])
        for at in range(0, len(pairs), chunk):
            i, k = pairs[at : at + chunk].T
            raw = _raw_kernels(_codes([words[x] for x in i], -1), _codes([self.marks[x] for x in k], -2), True)
            total = np.zeros(len(i), np.float32)
            for n, p in enumerate(ORDERS):
                norm = own[row[at : at + chunk], n] * self.own[k, n]
                total += np.where(norm > 0, raw[p - 1] / np.where(norm > 0, norm, 1), 0)
            out[i, k] = (total / len(ORDERS)) ** POWER
        out[out < FAINT] = 0
        return out

    def near(self, words: list[str], chunk: int = 16384) -> tuple[list[str], np.ndarray]:
        """The words close to any landmark and their rows of the kernel; memory is bounded by the chunk and what is found."""
        kept, rows = [], [np.zeros((0, len(self.marks)), np.float32)]
        for at in range(0, len(words), chunk):
            part = words[at : at + chunk]
            k = self.kernel(part)
            hot = np.flatnonzero(k.any(axis=1))
            kept += [part[i] for i in hot]
            rows.append(k[hot])
        return kept, np.concatenate(rows)


#: What a worker remembers of a token: its value, plus these if it ends a sentence or is a single letter.
_ENDS, _SINGLE = 1024.0, 4096.0


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # over kernel values, Nyström whitening folded in
    bias: float
    doc: np.ndarray  # logistic over document features
    version: str = ""
    prepared: Landmarks | None = None

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence's decision value; 0 for a word far from all landmarks."""
        if not self.landmarks:
            return np.zeros(len(words))
        if self.prepared is None:
            self.prepared = Landmarks(self.landmarks)
        return np.concatenate([self.prepared.kernel(words[at : at + 16384]) @ self.weights for at in range(0, len(words), 16384)] or [np.zeros(0)])

    def learn(self, raws: set[str]) -> dict[str, float]:
        """Remembers tokens' values and marks within bounds, and returns the store."""
        home = sys.modules.setdefault("_comboscan_toxic", types.ModuleType("_comboscan_toxic"))
        if getattr(home, "version", None) != self.version:
            home.version, home.known, home.older = self.version, {}, {}
        if len(home.known) > KEEP:
            home.known, home.older = {}, home.known
        known, older = home.known, home.older
        known.update((r, older[r]) for r in raws if r not in known and r in older)
        parts = [(r, clean(r)) for r in raws if r not in known]
        mark = lambda r, w: (_ENDS if ends_sentence(r) else 0.0) + (_SINGLE if len(w) == 1 else 0.0)
        long = {w: windows(w) for _, w in parts if len(w) > 1}
        words = list(dict.fromkeys(x for ws in long.values() for x in ws))
        value = dict(zip(words, self.values(words).tolist()))
        known.update((r, mark(r, w) + (max(map(value.__getitem__, long[w])) if w in long else 0.0)) for r, w in parts)
        return known

    def decide(self, texts: list[str | None]) -> list[np.ndarray]:
        """Document features of each text: a constant, the strongest sentence, sums over the strong ones, length."""
        cut = [(t or "").lower().split() for t in texts]
        known = self.learn(set().union(*cut))
        out = []
        for tokens in cut:
            v = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
            single = v > _SINGLE / 2
            v -= _SINGLE * single
            ends = v > _ENDS / 2
            v -= _ENDS * ends
            if single.any():
                for i, w in spelled(tokens, single):
                    v[i] = self.values(windows(w)).max()
            hot = np.flatnonzero(v)
            f = np.array([self.bias])
            if len(hot):
                of = sentences(ends)[hot]
                # the first value stands for all sentences without a word near a landmark
                f = np.concatenate([f, self.bias + np.bincount(np.unique(of, return_inverse=True)[1], weights=v[hot])])
            out.append(np.array([1.0, max(f.max(), -1.5), np.log1p(np.maximum(f + 0.25, 0).sum()), np.log1p((f > 0).sum()), np.log1p(len(tokens))]))
        return out

    def score_all(self, texts: list[str | None]) -> list[float]:
        z = np.clip(np.stack(self.decide(texts)) @ self.doc, -30, 30) if texts else np.zeros(0)
        return (1 / (1 + np.exp(-z))).tolist()

    def score(self, text: str | None) -> float:
        return self.score_all([text])[0]


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, other: int = OTHER) -> list[tuple[str, int]]:
    """(text, label) of at most ``toxic`` and ``other`` labelled documents, drawn by a hash of the text."""
    pairs = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    sizes = {r["y"]: r["count"] for r in pairs.groupBy("y").count().collect()}
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = lambda y, n: min(1.0, 3.0 * n / max(1, sizes.get(y, 0)))  # noqa: E731  the fold's share and duplicates leave enough
    few = pairs.where(draw("doc_id") < F.when(F.col("y") == 1, share(1, toxic)).otherwise(share(0, other)))
    # some three times the bounds in rows, ids and labels only: texts need not be shuffled to meet them
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").select("text", "y").distinct()
    w = Window.partitionBy("y").orderBy(F.xxhash64("text"), "text")
    kept = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("y") == 1, toxic).otherwise(other))
    return [(r["text"], r["y"]) for r in kept.select("text", "y").orderBy("y", F.xxhash64("text"), "text").toLocalIterator()]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on its active set; y is -1 or 1."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        on = y * (a @ w) < 1
        some = a[on]
        b = (some * weight[on, None].astype(x.dtype)).T
        new = np.linalg.solve(ridge + c * (b @ some).astype(float), c * b @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    r = np.eye(len(w)) * ridge
    r[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(r + (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p) - r @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _covering(strong: list[str], df: dict[str, list[int]], bags: list[list[str]], odds, most: int) -> list[str]:
    """Words that between them occur in the toxic documents, those of few other chosen words first, so that a language or
    topic with a small share of the sample has its landmarks too."""
    where: dict[str, list[int]] = {w: [] for w in strong}
    for i, words in enumerate(bags):
        for w in words:
            if w in where:
                where[w].append(i)
    had = np.zeros(len(bags))
    left, out = list(strong), []
    while left and len(out) < most:
        best = max(left, key=lambda w: (float(odds(df[w])) * float((1 / (1 + had[where[w]]) ** 2).sum()), w))
        left.remove(best)
        out.append(best)
        had[where[best]] += 1
    return out


def _sentence_rows(docs: list[str], row_of: dict[str, int], kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, document) of the sentences with a word near a landmark, and how many others there are."""
    feats, owner, rest = [], [], 0
    for d, text in enumerate(docs):
        tokens = text.lower().split()
        words = [clean(t) for t in tokens]
        of = sentences(np.array([ends_sentence(t) for t in tokens], bool))
        rest += int(of[-1]) + 1 if len(of) else 0
        runs = spelled(tokens, np.array([len(w) == 1 for w in words], bool))
        met: dict[int, np.ndarray] = {}  # only words in row_of count
        for i, w in [(i, w) for i, w in enumerate(words) if len(w) > 1] + runs:
            rows = [row_of[x] for x in windows(w) if x in row_of]
            if rows:
                met[int(of[i])] = met.get(int(of[i]), 0) + kernel[rows].max(axis=0)
        feats += met.values()
        owner += [d] * len(met)
        rest -= len(met)
    return np.array(feats, dtype=np.float32).reshape(-1, kernel.shape[1]), np.array(owner, dtype=int), rest


def train(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """A model from (text, label) rows. Without both labels every text scores the share of toxic rows (0 without rows)."""
    base = float(np.mean([y for _, y in rows])) if rows else 0.0
    flat = np.array([np.log(max(base, 1e-9) / max(1 - base, 1e-9)), 0, 0, 0, 0])
    nothing = Model([], np.zeros(0), -1.0, flat, "flat")
    if len({y for _, y in rows}) < 2:
        return nothing
    held = [i % 3 == 2 for i in range(len(rows))]  # kept for the documents' logistic
    fit = [r for r, h in zip(rows, held) if not h]
    n1, n0 = sum(y for _, y in fit), sum(1 - y for _, y in fit)
    df: dict[str, list[int]] = {}
    bags = []
    for text, y in fit:
        tokens = text.lower().split()
        words = [clean(t) for t in tokens]
        runs = spelled(tokens, np.array([len(w) == 1 for w in words], bool))
        bag = dict.fromkeys(x for w in [w for w in words if len(w) > 1] + [w for _, w in runs] for x in windows(w))
        for w in bag:
            df.setdefault(w, [0, 0])[y] += 1
        if y:
            bags.append(list(bag))
    # landmarks: words seen mostly in toxic documents that between them cover those, and the frequent harmless words most like them
    odds = lambda c: np.log((c[1] + 0.5) / (n1 + 1)) - np.log((c[0] + 0.5) / (n0 + 1))
    need = 3 if n1 >= 100 else 2
    telling = {w: c for w, c in df.items() if c[1] >= need and odds(c) > 1.6}
    if not telling:
        return nothing
    strong = sorted(telling, key=lambda w: (-telling[w][1] * odds(telling[w]), w))[: 4 * landmarks]
    marks = _covering(strong, telling, bags, odds, 4 * landmarks // 5)
    plain = sorted((w for w, c in df.items() if w not in telling and odds(c) < 0.7 and c[0]), key=lambda w: (-df[w][0], w))[:12_000]
    close = Landmarks(marks).kernel(plain).max(axis=1)
    bad = list(marks)
    marks = list(dict.fromkeys(marks + [plain[i] for i in np.argsort(-close, kind="stable")[: landmarks - len(marks)]]))

    near = Landmarks(marks)
    kmm = near.kernel(marks).astype(float)
    val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
    white = vec / np.sqrt(np.maximum(val, 1e-4))
    words, kernel = near.near(sorted(df))
    row_of = {w: k for k, w in enumerate(words)}
    del df, telling, plain
    pos, owner, _ = _sentence_rows([t for t, y in fit if y], row_of, kernel)
    neg, _, silent = _sentence_rows([t for t, y in fit if not y], row_of, kernel)
    if not len(pos):
        return nothing
    # inserted letters do not make a sentence harmless: the toxic landmarks, once with each inner letter doubled or followed by another
    worn = [m[: i + 1] + c + m[i + 1 :] for m in bad for i in range(1, len(m) - 1) for c in (m[i], "x")]
    extra = near.kernel(worn)
    # all sentences without a word near a landmark have the same features: one row with their weight, bounded
    silence, white = np.zeros((1, len(marks)), np.float32), white.astype(np.float32)
    x = np.vstack([rows @ white for rows in (pos, neg, silence, extra)])
    y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg) + 1), np.ones(len(extra))])
    chosen = np.ones(len(pos), bool)
    w, b = np.zeros(len(marks)), 0.0
    for _ in range(ROUNDS):
        share = np.bincount(owner[chosen], minlength=owner.max() + 1)
        weight = np.concatenate([np.where(chosen, 1 / np.maximum(share[owner], 1), 0), np.full(len(neg), 0.5), [min(silent, 200) + 1], np.full(len(extra), WORN * len(pos) / max(1, len(extra)))])
        on = weight > 0
        w, b = _svm(x[on], y[on], weight[on])
        f = x[: len(pos)] @ w + b
        top = np.full(owner.max() + 1, -np.inf)
        np.maximum.at(top, owner, f)
        before, chosen = chosen, (f > 0) | (f == top[owner])
        if (before == chosen).all():
            break
    model = Model(marks, (white @ w).astype(np.float32), b, flat, f"{hash((tuple(marks), b))}")
    calib = [r for r, h in zip(rows, held) if h] if len(rows) >= 300 else rows
    if len({v for _, v in calib}) == 2:
        features = [f for at in range(0, len(calib), 200) for f in model.decide([t for t, _ in calib[at : at + 200]])]
        model.doc = _logistic(np.array(features), np.array([v for _, v in calib], float))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs``, score (0 to 1) and predicted (1 from ``threshold`` up), from the whole text alone.

    Null and empty texts get the score of a text without words. Equal texts get equal scores. Input columns called score or
    predicted are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out: list[float] = []
        for at in range(0, len(texts), 1000):  # words new to a batch are compared together
            out += held.value.score_all(texts.iloc[at : at + 1000].tolist())
        return pd.Series(out, dtype="float64")

    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*rest, score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
