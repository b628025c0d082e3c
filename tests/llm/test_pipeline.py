import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    def s(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stages_keep_clean_rows_and_take_effect(spark, tmp_path):
    rnd = random.Random(8)
    vocab = {k: ["".join(rnd.choice(a) + rnd.choice(b) for _ in range(3)) for _ in range(400)] for k, (a, b) in {"xx": ("bdgklm", "aei"), "yy": ("prstvz", "ou")}.items()}
    text = lambda k, n: " ".join(rnd.choice(vocab[k]) for _ in range(n))
    rows = [(i, text("xx" if i % 2 else "yy", rnd.choice([60, 200])), "xx" if i % 2 else "yy", "s", 1) for i in range(200)]
    item = text("xx", 30)
    near = rows[4][1].split()
    near[10] = "changed"
    half = rows[6][1].split()
    half = " ".join(x if i % 9 else f"n{i}" for i, x in enumerate(half))
    rows += [(300, rows[2][1], "yy", "s", 1), (301, " ".join(near), "yy", None, 1), (302, half, "yy", "s", 1), (303, text("xx", 50) + " " + item.upper() + " " + text("xx", 50), "xx", "s", 1)]
    rows += [(304, text("yy", 40) + " mail me@host.org now", None, "s", None), (305, None, "xx", "s", 0), (306, "", "xx", "s", 0), (307, "1234 5678", "xx", "s", 9), rows[9], (None, text("xx", 80), None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert len(seen[-1]) == docs.count() or name == "language ID"
    assert set(r[0] for r in rows) - set(seen[0]) == {305, 306, 307}
    # the group of a near copy keeps its smallest id; what is under 0.8 stays
    assert jaccard(rows[6][1], half) < 0.8 <= jaccard(rows[4][1], " ".join(near))
    assert set(seen[0]) - set(seen[1]) == {300, 301}
    assert set(seen[1]) - set(seen[2]) == {303}
    assert set(seen[2]) == set(seen[3]) and "me@host.org" not in seen[3][304]["text"]
    assert all(seen[3][i]["text"] == t for i, t, *_ in rows if i in seen[3] and i != 304)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(seen[3])


def test_near_copies_of_sf_tables_are_found(spark):
    from comboscan.llm import simhash

    rnd = random.Random(9)
    base = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(150)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        for _ in range(2):
            w[rnd.randrange(len(w))] = "edit"
        rows.append((1000 + i, " ".join(w)))
    kept = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(120)) <= kept
    close = [i for i in range(120) if jaccard(rows[i][1], rows[120 + i][1]) >= 0.8]
    missed = sum(1000 + i in kept for i in close)
    assert missed <= 0.1 * len(close) and all(1000 + i in kept for i in range(120) if i not in close)


def test_callers_columns_survive_every_stage(spark, tmp_path):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("bdgklm") + rnd.choice("aei") for _ in range(3)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)) + (" mail a@b.org" if i % 3 == 0 else ""), "xx", "s", 7, i / 4, i, "mine", 0.5, i % 2 == 0, f"k{i}", i, i, f"t{i}") for i in range(40)]
    rows += [(None, rows[3][1], None, None, None, None, None, None, None, None, None, None, None, None), (90, None, None, None, None, 1.0, 1, "x", 1.0, True, "k", 1, 1, "t"), (91, " ".join(rnd.choice(words) for _ in range(60_000)), "xx", "s", 1, 2.0, 2, "y", 2.0, False, "k", 2, 2, "t")]
    schema = COLUMNS + ", Score double, entities int, lang_pred string, distance double, rejected boolean, key string, node long, component_id long, fingerprint string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that is in no document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want, columns = {r[0]: tuple(r)[5:] for r in rows if r[0] is not None}, docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert docs.columns == columns
        got = docs.collect()
        assert got and all(tuple(r)[5:] == want[r["doc_id"]] for r in got if r["doc_id"] is not None), name
    assert {91} <= {r["doc_id"] for r in got} and 90 not in {r["doc_id"] for r in got}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == {r["doc_id"] for r in got}


def test_empty_tables_run_through(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
