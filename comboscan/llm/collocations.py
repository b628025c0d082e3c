"""Phrase collocations of each language: n-grams as rows, counts by hash aggregation, the weakest cut's score, maximal phrases only.

A phrase with enough occurrences has only parts with as many. So words and pairs are counted of the whole text, and phrases of each
further length of the stretches whose every phrase one word shorter is frequent: those are found by a bit set of fixed size,
which may let a rare phrase through (it is counted and dropped) but never keeps a frequent one out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch, ship_package

#: Bits of the set of frequent phrases: 8 MB whatever the corpus, so it may be broadcast; a fuller set only lets more rows through.
BITS = 1 << 26
#: Words whose hash a worker remembers before it starts anew.
KNOWN = 1_000_000
#: What ends a stretch of words.
MARKS = ".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_pieces(docs: DataFrame) -> DataFrame:
    """(lang, words): one row for each stretch of a text between punctuation or line ends; null texts have none.

    One translation lowers letters and makes every mark a line end and every tab a space, so that both splits are at one letter.
    """
    text = F.translate("text", UPPER + "\t" + MARKS, LOWER + " " + "\n" * len(MARKS))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "\n")).alias("piece")).where("piece <> ''")
    return rows.select("lang", F.filter(F.split("piece", " "), lambda w: w != "").alias("words"))


def grams(rows: DataFrame, n: int) -> DataFrame:
    """(lang, n, phrase): a row for every occurrence of a phrase of n words."""
    words = F.col("words")
    phrase = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return rows.select("lang", F.lit(n).alias("n"), F.explode(F.transform(starts, phrase)).alias("phrase"))


def words_and_pairs(rows: DataFrame) -> DataFrame:
    """(lang, n, phrase, f) of all words (n = 1) and pairs (n = 2), and how many words each language has (n = 0).

    Each word is one row with its follower, an empty one at a stretch's end; a word's count is the sum of its followers', a language's that
    of its words'. Sums read the exchange of what they sum: what tells pairs apart is asked of their count, as a condition on the follower
    would be pushed below it and make another.
    """
    words = F.col("words")
    each = rows.select("lang", F.explode(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("v")))).alias("g")).select("lang", "g.*")
    pairs = each.groupBy("lang", "w", "v").agg(F.count(F.lit(1)).alias("f"))
    row = lambda df, n, phrase, f: df.select("lang", F.lit(n).alias("n"), phrase.alias("phrase"), f.alias("f"))
    both = row(pairs, 2, F.concat_ws(" ", "w", "v"), F.when(F.col("v") == "", F.lit(0)).otherwise(F.col("f")))
    single = pairs.groupBy("lang", "w").agg(F.sum("f").alias("f"))
    every = single.groupBy("lang").agg(F.sum("f").alias("f"))
    return both.unionByName(row(single, 1, F.col("w"), F.col("f"))).unionByName(row(every, 0, F.lit(""), F.col("f")))


def word_code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def phrase_codes(codes: np.ndarray, langs: np.ndarray, n: int, size: int) -> np.ndarray:
    """Place in the bit set of the n words from each position on; the last n - 1 positions have none."""
    out = langs[: len(codes) - n + 1].copy()
    for k in range(n):
        out = (out ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out % np.uint64(size)).astype(np.int64)


def bit_set(frequent: DataFrame, n: int) -> np.ndarray:
    """The bit set of the frequent phrases of n words: made in partitions, joined on the driver as at most BITS / 64 words."""
    size = BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [p.split(" ") for p in pdf["phrase"]]
            if not words:
                continue
            codes = np.array([word_code(w) for ws in words for w in ws], np.uint64)
            langs = np.repeat(np.array([word_code(x) for x in pdf["lang"]], np.uint64), n)
            at = np.unique(phrase_codes(codes, langs, n, size)[::n])
            yield pd.DataFrame({"word": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    packed = frequent.where(F.col("n") == n).select("lang", "phrase").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out, rows = np.zeros(size // 64, np.uint64), packed.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def stretches(rows: DataFrame, frequent: DataFrame, n: int) -> DataFrame:
    """(lang, words): the parts of more than n words in which every phrase of n words may be frequent."""
    held = rows.sparkSession.sparkContext.broadcast(bit_set(frequent, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value, {}
        for batch in batches:
            lists = batch.column(1)
            words, offsets = lists.flatten(), np.diff(lists.offsets.to_numpy())
            if len(words) <= n:
                continue
            coded = words.dictionary_encode()
            fresh = []
            for w in coded.dictionary.to_pylist():
                code = known.get(w)
                if code is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    code = known[w] = word_code(w)
                fresh.append(code)
            codes = np.array(fresh, np.uint64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(offsets)), offsets)
            tongue = batch.column(0).dictionary_encode()
            langs = np.array([word_code(x) for x in tongue.dictionary.to_pylist()], np.uint64)[tongue.indices.to_numpy()][row]
            at = phrase_codes(codes, langs, n, 64 * len(bits))
            ok = ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & (row[: len(at)] == row[n - 1 :])
            # runs of good positions of one row; of at least two they hold more than n words
            on = ok[1:] & ok[:-1] & (row[1 : len(at)] == row[: len(at) - 1])
            first = np.flatnonzero(ok & ~np.concatenate([[False], on]))
            last = np.flatnonzero(ok & ~np.concatenate([on, [False]])) + 1
            long = last - first >= 2
            first, last = first[long], last[long] + n - 1
            if not len(first):
                continue
            sizes = last - first
            starts = np.concatenate([[0], np.cumsum(sizes)])
            index = np.repeat(first - starts[:-1], sizes) + np.arange(starts[-1])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.take(pa.array(index)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), lists], ["lang", "words"])

    return rows.mapInArrow(run, "lang string, words array<string>")


def count_phrases(docs: DataFrame, max_n: int, at_least: int) -> DataFrame:
    """(lang, n, phrase, f) of the phrases that occur ``at_least`` times, and of n = 0: all words."""

    enough = lambda df: materialize(df.where((F.col("f") >= at_least) | (F.col("n") == 0)), "grams")
    rows = split_pieces(docs)
    found = [enough(words_and_pairs(rows))]
    for n in range(2, max_n):
        rows = materialize(stretches(rows, found[-1], n), "stretches")
        found.append(enough(grams(rows, n + 1).groupBy("lang", "n", "phrase").agg(F.count(F.lit(1)).alias("f"))))
    return reduce(DataFrame.unionByName, found)


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)) of counts, exact: products are decimals of 38 digits and the division is that of whole numbers."""
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * ({whole(a)} * {whole(n)})) div ({whole(left)} * {whole(right)})")


def mine(docs: DataFrame, max_n: int = 5, at_least: int = 100, cover: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``max_n`` words.

    ``docs`` needs text and lang. A phrase is a candidate if it occurs ``at_least`` times (a); its score is the least of
    floor(1000 * a * n / (l * r)) over the cuts into a first part (l occurrences) and a rest (r), ties to the shortest first part;
    n is all words of the language. Candidates inside a longer candidate with ``cover`` percent of their occurrences or more are dropped: as a
    phrase between the two occurs no less often than the longer, one-word extensions say it all. Null texts hold no words, a null
    lang is ``und``; repeated rows count again; very long texts are split into pieces before they are words; ties rank by a, then by
    the phrase's bytes; an empty table gives no rows; other columns are not read. Sums are exact in decimals of 38 digits.
    """
    ship_package(docs.sparkSession)
    with scratch(docs.sparkSession) as made:
        counts = materialize(count_phrases(docs.select("text", "lang"), max_n, at_least), "phrases")
        made.pop()  # the phrases stay, for the lazy result
    totals, counts = counts.where("n = 0").select("lang", F.col("f").alias("total")), counts.where("n > 0")
    candidates = counts.where("n > 1")
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", "n", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    of = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumn("score", score("a", "total", "l", "r"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total", "n")).alias("c")).select("lang", "phrase", "c.*")
    longer = candidates.where("n > 2").withColumn("words", words)
    longer = longer.select("lang", F.col("f").alias("more"), F.explode(F.array(part(F.lit(1), F.col("n") - 1), part(F.lit(2), F.col("n") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = best.alias("b").join(longer.alias("x"), (F.col("b.lang") == F.col("x.lang")) & (F.col("b.phrase") == F.col("x.phrase")) & (F.col("x.more") * 100 >= F.col("b.a") * cover), "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
