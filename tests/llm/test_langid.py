from comboscan.llm import langid
from comboscan.llm.common import table
from comboscan.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    held = [(r["lang_pred"], truth[i]) for i, r in out.items() if r["held_out"]]
    assert len(out) == len(truth) and len(held) > 100
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert sum(r["rejected"] for r in out.values()) <= 0.005 * len(out)


def test_odd_rows_and_rejection(spark):
    words = {"xx": ["lamon", "torel", "sabin", "mero"], "yy": ["uchkt", "zwgrf", "prschk", "kvdt"]}
    rows = [(i, " ".join(words[k][(i * j) % 4] for j in range(1, 40)), k, None) for i in range(60) for k in words]
    model = langid.train(langid.sample(spark.createDataFrame(rows, SCHEMA)))
    odd = [(1, None, None, "s"), (2, "", None, None), (3, "123 !!", None, None), (4, rows[0][1], None, None), (4, rows[0][1], None, None),
           (5, "mero lamon " * 60_000, None, None), (6, "日本語の文章です", None, None)]
    got = sorted(map(tuple, langid.predict(spark.createDataFrame(odd, SCHEMA), model).select("doc_id", "lang_pred", "rejected").collect()))
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "xx", False), (4, "xx", False), (5, "xx", False), (6, got[6][1], True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predict(empty, model).count() == 0
    none = langid.train(langid.sample(empty))
    assert none.classify("words") == ("und", 0.0, 1.0, True)
