import random
import re
from collections import Counter

import duckdb

from comboscan.llm import collocations as C
from comboscan.llm import queries


def brute_force(rows, max_n, at_least, cover, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(str.maketrans(C.UPPER, C.LOWER))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in range(1, max_n + 1) for i in range(len(w) - m + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= at_least}
    out = []
    for (lang, w), a in good.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= cover * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in good.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    ranked, at = [], Counter()
    for lang, s, a, p, left, right, total in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, total, -s))
    return ranked


def corpus(seed):
    rnd = random.Random(seed)
    words = ["A", "b", "cc", "été", "x\x0by", "the", "of", "日本", "B"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rnd.randrange(1, 60))) for _ in range(120)]
    rows = [(i, t, rnd.choice(["en", "en", "de", None])) for i, t in enumerate(texts)]
    rows += [(900, "one two three four five six " * 40, "en"), (901, None, "en"), (902, "", None), (None, "no id here", "fr"), (903, "same same same same same same", "fr"), (904, ".,;:", "und")] + [(905, "of the people by the people", "de")] * 30
    return rows


def test_against_loops(spark, monkeypatch):
    monkeypatch.setattr(C, "BITS", 1 << 10)  # a crowded set lets rows through and loses none
    for seed, (max_n, at_least, cover, top) in enumerate([(5, 6, 100, 2000), (4, 3, 60, 7), (2, 10, 100, 5)]):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
        got = [tuple(r) for r in C.mine(df, max_n, at_least, cover, top).collect()]
        assert sorted(got) == sorted(brute_force(rows, max_n, at_least, cover, top)) and got
    assert C.mine(df.where("false")).count() == 0


def test_stretches_hold_every_frequent_phrase(spark):
    df = spark.createDataFrame([(1, "a b c d e f. a b c d", "en")] * 3 + [(2, "a x c d b c", "en")], "doc_id long, text string, lang string")
    rows = C.split_pieces(df)
    frequent = C.grams(rows, 2).groupBy("lang", "n", "phrase").count().where("count >= 3")
    got = Counter(" ".join(r["words"]) for r in C.stretches(rows, frequent, 2).collect())
    assert got == {"a b c d e f": 3, "a b c d": 3}


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "hot cold, " * 200_000 + "tail " * 50_000, "en")], "doc_id long, text string, lang string")
    got = {r["phrase"]: r["a"] for r in C.mine(df).collect()}
    assert got == {"hot cold": 200_000, "tail tail tail tail tail": 49_996, "tail tail": 49_999, "tail tail tail": 49_998, "tail tail tail tail": 49_997}


def test_products_beyond_64_bits(spark):
    # 1000 * a * n with a and n of 10^9 each passes 2^63: the same arithmetic on counts, without the rows
    row = spark.createDataFrame([(3_000_000_000, 9_000_000_007, 3_000_000_001, 4_000_000_003)], "a long, total long, l long, r long")
    assert row.select(C.score("a", "total", "l", "r").alias("s")).first()[0] == 1000 * 3_000_000_000 * 9_000_000_007 // (3_000_000_001 * 4_000_000_003)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op11(spark, sf)
    rel = con.sql(queries.ORACLES["op11_collocations"])
    assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
