"""Stupid-backoff scores from count tables of the whole corpus, computed relationally in packed columns.

Documents are dealt into blocks. A block's distinct n-grams and counts, sorted by hash and cut into hash ranges, are the
exploded side, one packed row for each (range, block) that has any; a range's rows are summed into its part of the count tables
and the totals return to each block in the order they came, where they are joined to the block's n-grams and summed per document.
An n-gram is sent once for each block that has it, however often it occurs, so frequent n-grams make no hot key. Ranges grow in number
with the blocks, so a range's rows stay bounded; a corpus of very many blocks ends with rows of single n-grams.
A document is scored against the counts of all the others: its own are taken off.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .simhash import words

ALPHA = 0.4
#: Text bytes a block aims at; blocks and hash ranges grow in number with the corpus, neither grows in size.
BLOCK_BYTES = 16_000_000
_WORD = r"[^\x20\x09-\x0D]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def block_grams(texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts in words; word hashes; bigram hashes; whether a word starts its text (its bigram is void)."""
    seen: dict[bytes, int] = {}
    lengths, flat = [], []
    for t in texts:
        w = words(t)
        lengths.append(len(w))
        for x in w:
            h = seen.get(x)
            if h is None:
                h = seen[x] = xxhash.xxh64_intdigest(x)
            flat.append(h)
    one = np.array(flat, dtype=np.uint64)
    before = np.roll(one, 1)
    two = _mix(_mix(before + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + one)
    first = np.zeros(len(one), bool)
    starts = np.cumsum([0, *lengths[:-1]]) if lengths else np.zeros(0, int)
    first[[s for s, n in zip(starts, lengths) if n]] = True
    return lengths, one, two, first


def _squeeze(sorted_hashes: np.ndarray, low: int) -> bytes:
    """Gaps of sorted hashes from ``low`` up, in as few bytes each as the widest needs; the first byte says how many."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(low))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unsqueeze(raw: bytes, low: int) -> np.ndarray:
    width = raw[0]
    got = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, :width] = got
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64) + np.uint64(low)


def _small(n: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(n.max(initial=0)))
    return bytes([kind.itemsize]) + n.astype(kind.newbyteorder("<")).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def score_block(lengths: list[int], one: np.ndarray, two: np.ndarray, first: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], total: int, alpha: float) -> np.ndarray:
    """Sum of log scores of each document; ``tables`` has the (sorted hashes, corpus counts) of words and bigrams."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    others = []
    for grams, (keys, counts), real in ((one, tables[0], np.ones(len(one), bool)), (two, tables[1], ~first)):
        at = np.searchsorted(keys, grams)
        at[~real] = 0
        own_key = doc[real].astype(np.int64) * max(1, len(keys)) + at[real]
        _, inverse, n = np.unique(own_key, return_inverse=True, return_counts=True)
        left = np.zeros(len(grams), np.int64)
        left[real] = counts[at[real]] - n[inverse]
        others.append(left)
    c1, c2 = others
    rest = (total - np.asarray(lengths, np.int64))[doc]
    with np.errstate(divide="ignore", invalid="ignore"):
        alone = np.where(c1 > 0, np.log(c1) - np.log(rest), -np.log(rest + 1.0))
        given = np.log(c2) - np.log(np.roll(c1, 1))
    s = np.where(first, alone, np.where(c2 > 0, given, math.log(alpha) + alone))
    return np.bincount(doc, weights=s, minlength=len(lengths))


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, tokens and log_score of every row: the sum over its words of log S.

    S of a first word is c(w) / N, or 1 / (N + 1) if no other row has it; S of a later word w after v is c(vw) / c(v) if another row has
    vw, else alpha times the former. Words: A-Z lowered, cut at ASCII white space. c and N count all rows but the
    scored one, copies included. Null and empty texts: 0 tokens, score 0. Repeated rows are rows of their own; rows alike in
    all carried columns and the text share a block. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    names = [f"_c{i}" for i in range(len(carry))]
    src = docs.select(*[F.col(c).cast("string").alias(n) for c, n in zip(carry, names)], F.col(text).alias("_text"))
    size, total = src.agg(F.sum(F.octet_length("_text")), F.sum(F.regexp_count("_text", F.lit(_WORD)))).first()
    blocks, total = max(1, -(-(size or 0) // block_bytes)), total or 0
    bits = min(blocks.bit_length(), 40)
    # dealt by what a row holds: the two readings agree even where a lost task is run again, and copies under many ids are spread
    dealt = src.withColumn("block", F.pmod(F.xxhash64(*names, "_text", F.lit(7)), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block")

    def distinct(one, two, first):
        return [np.unique(x, return_counts=True) for x in (one, two[~first])]

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, one, two, first = block_grams(pdf["_text"].tolist())
        block, out = int(pdf["block"].iloc[0]), []
        for order, (keys, n) in enumerate(distinct(one, two, first)):
            of = keys >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.diff(of, prepend=~of[:1])) if len(of) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                r = int(of[a])
                out.append((r, block, order, _squeeze(keys[a:b], r << (64 - bits)), _small(n[a:b])))
        return pd.DataFrame(out, columns=["range", "block", "part", "keys", "n"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        low = int(pdf["range"].iloc[0]) << (64 - bits)
        keys = [_unsqueeze(k, low) for k in pdf["keys"]]
        all_keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([_numbers(n) for n in pdf["n"]]), minlength=len(all_keys)).astype(np.int64)
        at = 0
        for block, r, order, k in zip(pdf["block"], pdf["range"], pdf["part"], keys):
            out.append((block, r, order, _small(counts[inverse[at : at + len(k)]])))
            at += len(k)
        return pd.DataFrame(out, columns=["block", "range", "part", "n"])

    def scored(pdf: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({**{n: [] for n in names}, "tokens": [], "log_score": []})
        lengths, one, two, first = block_grams(pdf["_text"].tolist())
        totals = totals.sort_values(["part", "range"])
        tables = []
        for order, (keys, _) in enumerate(distinct(one, two, first)):
            counts = [_numbers(n) for n in totals.loc[totals["part"] == order, "n"]]
            tables.append((keys, np.concatenate([np.zeros(0, np.int64), *counts])))
            if len(tables[-1][1]) != len(keys):
                raise RuntimeError("a block's n-grams changed between its two readings")
        s = score_block(lengths, one, two, first, tables, total, alpha)
        return pdf[names].assign(tokens=lengths, log_score=s)

    up = dealt.groupBy("block").applyInPandas(counted, "range long, block int, part int, keys binary, n binary")
    down = up.groupBy("range", "part").applyInPandas(summed, "block int, range long, part int, n binary")
    out = dealt.groupBy("block").cogroup(down.groupBy("block")).applyInPandas(scored, ", ".join([f"{n} string" for n in names] + ["tokens long", "log_score double"]))
    return out.select(*[F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in zip(carry, names)], "tokens", "log_score")
