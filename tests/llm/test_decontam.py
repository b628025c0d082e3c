import random
import re

from comboscan.llm import decontam

DOCS = "doc_id long, text string, key string, item_id string"
ITEMS = "item_id long, text string, n int"


def grams(t):
    w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("xyzuvw") + str(rnd.randrange(9))
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 5, 7, 12, 40, 90]))), 0) for i in range(60)]
    items += [(100, None, 0), (101, "", 0), items[7], (7, "other text under the same id here", 0)]
    docs = []
    for i in range(200):
        w = [word() for _ in range(rnd.choice([0, 10, 200]))]
        if i % 3 == 0:
            t = items[rnd.randrange(60)][1].split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = "zz"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rnd.choice(["", ",", "."]) for x in t]
        docs.append((i, " ".join(w), "clash", None))
    docs += [(None, items[4][1] + " tail", None, None), (500, None, None, None), docs[0], (501, "filler words go on " * 30_000 + items[5][1], None, None)]
    want = set()
    for d, t, *_ in docs:
        for i, u, _ in items:
            g = grams(u)
            if g and len(grams(t) & g) * 10 >= len(g) * 8:
                want.add((d, i, len(grams(t) & g), len(g)))
    ds, bs = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = [(r["doc_id"], r["item_id"], r["matched"], r["item_shingles"]) for r in decontam.contained(ds, bs).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 30
    bad = {t for d, t, *_ in docs for i, u, _ in items if grams(u) and len(grams(t) & grams(u)) * 10 >= len(grams(u)) * 8}
    kept = decontam.clean(ds, bs)
    assert kept.columns == ds.columns
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, kept.collect())) == order(r for r in docs if r[1] not in bad)
    none = spark.createDataFrame([], ITEMS)
    assert decontam.contained(ds, none).count() == 0 and decontam.clean(ds, none).count() == len(docs)
    assert decontam.contained(spark.createDataFrame([], DOCS), bs).count() == 0
