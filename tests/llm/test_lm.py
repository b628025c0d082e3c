import math
import random
from collections import Counter

from comboscan.llm import lm

SCHEMA = "doc_id long, text string, tokens string, block int"


def brute(rows):
    docs = [(r[0], (r[1] or "").lower().split()) for r in rows]
    c1, c2 = Counter(), Counter()
    for _, w in docs:
        c1.update(w)
        c2.update(zip(w, w[1:]))
    total = sum(c1.values())
    out = []
    for i, w in docs:
        o1, o2 = Counter(w), Counter(zip(w, w[1:]))
        rest, s = total - len(w), 0.0
        for k, x in enumerate(w):
            n = c1[x] - o1[x]
            alone = math.log(n / rest) if n else -math.log(rest + 1)
            if k:
                b = c2[w[k - 1], x] - o2[w[k - 1], x]
                s += math.log(b / (c1[w[k - 1]] - o1[w[k - 1]])) if b else math.log(lm.ALPHA) + alone
            else:
                s += alone
        out.append((i, len(w), round(s, 6)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def test_scores_match_brute_force_in_any_number_of_blocks(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(vocab[: rnd.choice([5, 60])]) for _ in range(rnd.choice([0, 1, 2, 50]))), None, 3) for i in range(120)]
    rows += [(200, None, None, None), (201, "", "x", None), (None, "w1 w2 odd", None, None), rows[3], rows[3], (202, "w1 w2 " * 50_000, None, None), (203, "never seen words", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for size in (16_000_000, 40_000):
        got = lm.stupid_backoff(df, block_bytes=size).collect()
        mine = sorted(((r["doc_id"], r["tokens"], round(r["log_score"], 6)) for r in got), key=lambda r: tuple((x is None, x) for x in r))
        for a, b in zip(mine, brute(rows), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-6 * max(1, abs(b[2]))
    assert lm.stupid_backoff(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lm.stupid_backoff(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect()[0]["log_score"] == 0
