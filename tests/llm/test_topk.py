import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from comboscan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k, step):
    v = [(i, [math.floor(256.0 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (q, a) in enumerate(v):
        if q % step == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(v) if m != n and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0, 1) for i in range(600)]
    rows += [(700 + i, rows[3][1], 0, 1) for i in range(30)]  # ties
    rows += [(50, None, 0, 0), (801, [float("nan")] * 12, 0, 0), (802, [None] * 12, 0, 0), (803, [float("inf")] * 12, 0, 0), (None, rows[0][1], 0, 0), (850, [1.0, 2.0], 0, 0), (851, [1.0, -2.0], 0, 0)]
    rows += [(100, rows[5][1], 0, 0), rows[200], (850, [2.0, 2.0], 0, 0)]  # another row with a query's id is a candidate, and a query itself
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, 50)
    for block, qb in ((8192, 2048), (100, 4)):
        got = topk.top_k(df, lambda i: i % 50 == 0, block=block, query_block=qb).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top_k(spark.createDataFrame([], SCHEMA), lambda i: i % 50 == 0).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 6), st.integers(1, 8))
def test_bounds_never_lose_a_winner(seed, n, d, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, d))
    ids = np.arange(n)
    a, b, s = topk.nra(ids[:20], x[:20], ids, ids, x, k)
    for q in range(min(20, n)):
        want = sorted((-int(x[q] @ x[c]), c) for c in range(n) if c != q)[:k]
        assert sorted((-int(y), int(c)) for r, c, y in zip(a, b, s) if r == q) == want
