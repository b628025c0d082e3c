"""Language identification by nearest centroid over TF-IDF character n-grams, with distance-based rejection.

Training reads a bounded sample of labelled rows (``PER_LANG`` for each language), weighs hashed 1- to 3-grams by TF-IDF,
normalises, and clusters each language into a few spherical k-means centroids. A text is given the language of its nearest
centroid by cosine; one farther from it than that language's radius is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship_package

DIMS, ORDERS = 1 << 14, (1, 2, 3)
#: Documented bound of the training sample: documents of one language.
PER_LANG = 300
#: Documented bound of the languages learnt: those of most rows, ties by name.
LANGS = 200
CENTROIDS = 3
#: A text is rejected below this share of the similarity that the language's least typical training texts have.
SLACK = 0.25
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PRIMES = (1, 0x9E3779B1, 0x85EBCA6B)


def letters(text: str | None) -> str:
    """Lower-cased text with everything but letters as single spaces; empty if it has no letter."""
    t = _NOT_LETTERS.sub(" ", text.lower()) if text else ""
    return f" {t.strip()} " if any(c.isalpha() for c in t) else ""


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed n-grams of what letters() returned; long texts are counted in steps."""
    total = np.zeros(DIMS, np.int64)
    step = 1 << 16
    for at in range(0, len(text), step):
        part = text[at : at + step + max(ORDERS) - 1]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        for n in ORDERS:
            starts = min(step, len(c) - n + 1)
            if starts <= 0:
                continue
            h = np.full(starts, n * 0xC2B2AE35, np.uint64)
            for k in range(n):
                h = (h ^ c[k : k + starts]) * np.uint64(0x100000001B3) + np.uint64(_PRIMES[k])
            total += np.bincount(((h ^ (h >> np.uint64(29))) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # DIMS x centroids
    radius: np.ndarray  # by language

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        v = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(v @ v)
        return at, v / norm if norm else v

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, distance, rejected); und, 0 and 1 for a text without letters or a model without languages."""
        t = letters(text)
        if not t or not self.langs:
            return "und", 0.0, 1.0, True
        at, v = self.vector(t)
        sims = v @ self.centroids[at]
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, sims)
        k = int(best.argmax())
        e = np.exp(20 * (best - best[k]))
        distance = float(1 - best[k])
        return self.langs[k], float(1 / e.sum()), distance, bool(distance > self.radius[k])


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_lang`` rows of each language, drawn by a hash of the text; labels but no texts are
    counted first, so one language with most rows costs no sort."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not sizes:
        return []
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_lang / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.where(draw < share).withColumn("draw", draw)
    # a constant times per_lang rows for each language are left, unless texts repeat; each keeps its first per_lang
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("draw", "text")
    kept = few.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_lang)
    return [(r["lang"], r["text"]) for r in kept.select("lang", "text").orderBy("lang", "draw", "text").toLocalIterator()]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of spherical k-means, started from texts far apart."""
    at = [int((x @ x.mean(axis=0)).argmax())]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    # a centroid of a handful of odd texts would catch other odd texts of any language
    size = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
    return c[size >= max(1, 0.03 * len(x))]


def train(rows: list[tuple[str, str]], centroids: int = CENTROIDS) -> Model:
    """A model from (lang, text) rows; texts without a letter teach nothing."""
    rows = [(lang, t) for lang, text in rows if (t := letters(text))]
    langs = sorted({lang for lang, _ in rows})
    df = np.zeros(DIMS)
    grams = [counts(t) for _, t in rows]
    for at, _ in grams:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    owner, cents, radius = [], [], []
    for k, lang in enumerate(langs):
        own = [g for g, (other, _) in zip(grams, rows) if other == lang]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (at, n) in enumerate(own):
            x[i, at] = (1 + np.log(n)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _cluster(x, centroids)
        cents.append(c)
        owner += [k] * len(c)
        radius.append(1 - SLACK * float(np.quantile((x @ c.T).max(axis=1), 0.01)))
    return Model(langs, np.array(owner, int), idf, np.concatenate(cents).T.astype(np.float64) if cents else np.zeros((DIMS, 0)), np.array(radius))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, distance, rejected, from the whole text alone.

    Null, empty and letterless texts: und, score 0, distance 1, rejected. Equal texts get equal rows. Input columns with the names of
    the results are replaced. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, distance double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        out = [held.value.classify(t) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score", "distance", "rejected"])

    # so marked, a filter on the result is not pushed below it, which would classify every text twice
    once = classify.asNondeterministic()
    new = ["lang_pred", "score", "distance", "rejected"]
    rest = [c for c in docs.columns if c.lower() not in new]
    r = "_langid"
    while r in rest:
        r += "_"
    return docs.withColumn(r, once(F.col(text))).select(*rest, *[F.col(r)[c].alias(c) for c in new])


def training_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows a model may learn from: those outside fold 0 of crc32(doc_id as text)."""
    return docs.where(fold(F.col("doc_id"), folds) != 0)
