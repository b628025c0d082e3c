import random
from collections import Counter

import xxhash

from comboscan.llm import simhash

SCHEMA = "doc_id long, text string, node string, f0 string"


def plain(text):
    w, cur = [], ""
    for ch in text or "":
        if ch in "\x20\t\n\x0b\x0c\r":
            w, cur = w + [cur] * bool(cur), ""
        else:
            cur += ch.lower() if "A" <= ch <= "Z" else ch
    w += [cur] * bool(cur)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    f = [plain(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(f[i] ^ f[j]).count("1") <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    key = lambda t: tuple((x is None, x) for x in t)
    return sorted(((r[0], f"{f[i]:016x}", least.get(root(i))) for i, r in enumerate(rows)), key=key)


def test_components_match_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(80)] + ["É", "Ü", "a b", " "]
    rows = []
    for i in range(150):
        t = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 60, 300]))]
        rows.append((i, " ".join(t), None, None))
        if len(t) > 50:
            for j in range(3):
                u = list(t)
                u[rnd.randrange(len(u))] = "ZZ"
                rows.append((1000 + 3 * i + j, "\t".join(u), "x", None))
    rows += [(5000, None, None, None), (4999, "", None, None), (4998, " \n ", None, None), (None, rows[0][1], None, None), rows[7], rows[7], (6000, "Long word " * 40_000, None, None)]
    got = simhash.components(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=key) == groups(rows)
    assert simhash.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_buckets_lose_no_link(spark):
    rnd = random.Random(2)
    base = 0x0123456789ABCDEF
    f = {base}
    while len(f) < 400:  # one crowd around a centre
        x = base
        for _ in range(rnd.randrange(1, 7)):
            x ^= 1 << rnd.randrange(12)
        f.add(x)
    f = sorted(f)
    pairs = simhash.near_links(spark.createDataFrame([(x,) for x in f], "f long")).collect()
    up = {x: x for x in f}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        assert bin(a ^ b).count("1") <= 2
        up[root(a)] = root(b)
    want = {x: x for x in f}

    def wroot(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(f):
        for b in f[:i]:
            if bin(a ^ b).count("1") <= 2:
                want[wroot(a)] = wroot(b)
    assert len({root(x) for x in f}) == len({wroot(x) for x in f})


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def close(s, t):
    x, y = shingle_set(s), shingle_set(t)
    return 10 * len(x & y) >= 8 * len(x | y)


def test_near_copies_of_any_kind_are_met(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], {"truncated": [], "extended": [], "passage cut": [], "scattered": []}
    for i in range(240):  # every base text has one copy, so that no other copy can link the two
        n = rnd.randrange(80, 700)
        base = [rnd.choice(vocab) for _ in range(n)]
        cut, at = int(n * rnd.uniform(0.1, 0.18)), rnd.randrange(n // 2)
        worn = list(base)
        for k in rnd.sample(range(n), max(1, n // 60)):
            worn[k] = "new"
        kinds = {"truncated": base[: n - cut], "extended": base + [rnd.choice(vocab) for _ in range(cut)], "passage cut": base[:at] + base[at + cut :], "scattered": worn}
        kind = list(kinds)[i % 4]
        rows += [(" ".join(base),), (" ".join(kinds[kind]),)]
        if close(rows[-1][0], rows[-2][0]):
            pairs[kind].append((rows[-2][0], rows[-1][0]))
    df = spark.createDataFrame(rows, "text string")
    key = {r["text"]: r["node"] for r in df.select("text", simhash._key("text").alias("node")).collect()}
    got = {frozenset((r["a"], r["b"])) for r in simhash.similar_pairs(df).collect()}
    for kind, wanted in pairs.items():
        met = sum(frozenset((key[a], key[b])) in got for a, b in wanted)
        print(kind, met, "of", len(wanted))
        assert len(wanted) > 25 and met == len(wanted)


def test_large_buckets_keep_all_true_groups(spark):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = set()
    while len(texts) < 300:  # copies of one text with a few edits each: many pairs of a bucket are just below the bound
        w = list(base)
        for k in rnd.sample(range(len(w)), rnd.randrange(1, 7)):
            w[k] = f"e{rnd.randrange(30)}"
        texts.add(" ".join(w))
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    key = {r["node"]: r["text"] for r in df.select("text", simhash._key("text").alias("node")).collect()}
    up = {n: n for n in key}
    want = dict(up)

    def root(u, x):
        while u[x] != x:
            x = u[x]
        return x

    sets = {n: shingle_set(t) for n, t in key.items()}
    for tile in (2048, 64):
        for r in simhash.similar_pairs(df, tile=tile).collect():
            x, y = sets[r["a"]], sets[r["b"]]
            assert 10 * len(x & y) >= 8 * len(x | y)
            up[root(up, r["a"])] = root(up, r["b"])
        nodes = sorted(key)
        for i, a in enumerate(nodes):
            for b in nodes[:i]:
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    want[root(want, a)] = root(want, b)
        print("groups", len({root(up, x) for x in nodes}), "true", len({root(want, x) for x in nodes}))
        assert len({root(up, x) for x in nodes}) == len({root(want, x) for x in nodes})
        up = {n: n for n in key}


def test_wanted_rows_are_found_by_bits(spark, monkeypatch):
    from comboscan.llm import common

    n = [0, 1, 63, 64, 65, 4000, (1 << 33) + 7, (1 << 40) + 63]
    rows = spark.createDataFrame([(x, f"t{x}", x) for x in n], "n long, _word string, bits long")
    for bound in (common.BITS_ROWS, 0):
        monkeypatch.setattr(common, "BITS_ROWS", bound)
        for some in ([], [63], [0, 64, 64, (1 << 33) + 7, 5], [*n, 2]):
            got = common.among(rows, "n", spark.createDataFrame([(x,) for x in some], "n long")).collect()
            assert sorted(map(tuple, got)) == [(x, f"t{x}", x) for x in n if x in some]


def test_dedup_moves_no_kept_row_and_leaves_no_other_table(spark):
    from pathlib import Path

    from comboscan.session import shared_dir

    rows = [(i, f"text number {i // 2} of many", None, i) for i in range(400)] + [(None, "alone", None, 1), (None, None, None, 2), (7, "text number 3 of many", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, none void, n long")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("*"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        out = simhash.deduplicate(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted(p.name.split("-")[0] for p in set(shared.glob("*")) - before) == ["bits", "rows"]
    assert out.dtypes == docs.dtypes
    want = [(2 * i, f"text number {i} of many", None, 2 * i) for i in range(200)]
    assert sorted(map(tuple, out.where("doc_id is not null").collect())) == want
    assert sorted(out.where("doc_id is null").select("n").collect()) == [(1,), (2,)]


def test_groups_of_a_whole_table_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: frozenset(simhash.shingles(simhash.words(t), 5)) for i, t in rows.items()}
    holds = {}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)
    common = Counter()
    for ids in holds.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for (a, b), n in common.items() if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    pairs += [(a, b) for a in rows for b in rows if a < b and not sets[a] and not sets[b]]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert got == {i for i in rows if find(i) == i} and len(pairs) > 50
