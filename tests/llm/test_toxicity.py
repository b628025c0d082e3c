import itertools
import math
import random

import numpy as np

from comboscan.llm import toxicity
from comboscan.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, predicted int"


def brute(s, t, p):
    def feats(x):
        out = {}
        for idx in itertools.combinations(range(len(x)), p):
            u = "".join(x[i] for i in idx)
            out[u] = out.get(u, 0) + toxicity.DECAY ** (idx[-1] - idx[0] + 1)
        return out

    a, b = feats(s), feats(t)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    n = dot(a, a) * dot(b, b)
    return dot(a, b) / n**0.5 if n else 0.0


def gated(word, mark):
    want = {mark[i : i + 2] for i in range(len(mark) - 1)}
    have = {word[i] + word[j] for i in range(len(word)) for j in range(i + 1, min(i + 4, len(word)))}
    return len(want & have) >= max(1, math.ceil(toxicity.GATE * len(want)))


def plain_kernel(word, mark):
    k = np.mean([brute(word, mark, p) for p in toxicity.ORDERS]) ** toxicity.POWER if gated(word, mark) else 0.0
    return k if k >= toxicity.FAINT else 0.0


def test_kernel_is_the_gated_subsequence_kernel():
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(60)} | {"abcab", "abca", "axbca", "é", "éa"})
    rnd.shuffle(words)
    marks = [w for w in words if len(w) > 1][:9] + ["zzz"]
    got = toxicity.Landmarks(marks).kernel(words, chunk=7)
    want = np.array([[plain_kernel(s, t) for t in marks] for s in words])
    assert np.abs(got - want).max() < 1e-5 and (want > 0).sum() > 20


def plain_score(model, text):
    """The score by loops over sentences, words and landmarks."""
    tokens = (text or "").lower().split()
    bare = ["".join(c for c in t if c.isalnum()) for t in tokens]
    value = lambda w: max(sum(plain_kernel(x, m) * b for m, b in zip(model.landmarks, model.weights)) for x in toxicity.windows(w))
    sums, run, n = [0.0], [], 0
    for i, (t, w) in enumerate(zip(tokens, bare)):
        if len(w) == 1:
            run.append(w)
            if len(run) > 2 and (i + 1 == len(bare) or len(bare[i + 1]) != 1):
                sums[-1] += value("".join(run))
        else:
            run = []
            sums[-1] += value(w) if w else 0.0
        n += 1
        if n == toxicity.SENTENCE or any(c in ".!?" for c in t[len(t.rstrip("".join(c for c in set(t) if not c.isalnum()))) :]):
            sums.append(0.0)
            n = 0
    f = [model.bias + s for s in sums if s] + [model.bias]
    x = [1, max(*f, -1.5), math.log1p(sum(max(v + 0.25, 0) for v in f)), math.log1p(sum(v > 0 for v in f)), math.log1p(len(tokens))]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.doc))))))


def test_scores_are_those_of_loops():
    data = rows(600, random.Random(1))
    model = toxicity.train(data, landmarks=12)
    rnd = random.Random(5)
    texts = [t for t, _ in data[:8]] + ["What an i.d.i.o.t! A m o r o n? You s c, u m b a g", "", None, "! ? ...", "x" * 60, "idiot" * 8 + " the idiots. " + "bo " * 90 + "morron"]
    texts += [" ".join(rnd.choice(["idiot", "idixot", "moron.", "a", "b!", "scumbags", "ladi", "dumo?", "--"]) for _ in range(60)) for _ in range(6)]
    assert np.allclose(model.score_all(texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_runs_and_windows_cover_whole_texts():
    tokens = "you i.d.i.o.t, s t u p i d! a b".split()
    assert toxicity.clean(tokens[1]) == "idiot"
    assert toxicity.spelled(tokens, np.array([len(toxicity.clean(t)) == 1 for t in tokens])) == [(9, "stupidab")]
    long = "".join(chr(97 + i % 26) for i in range(101))
    assert all(any(long[i : i + 12] in w for w in toxicity.windows(long)) for i in range(len(long) - 12))


def rows(n, rnd):
    plain = ["".join(rnd.choice("bcdfgklm") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(["idiot", "moron", "scumbag"])
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_gapped_words_are_caught_and_odd_rows_score(spark):
    model = toxicity.train(rows(600, random.Random(1)), landmarks=24)
    held = rows(200, random.Random(1))
    assert all((model.score(t) >= 0.3) == bool(y) for t, y in held)
    for t in ("you idiiot", "what an id-iot", "i d i o t here", "such a morron", "MORON"):
        assert model.score(t) >= 0.3, t
    odd = [(1, None, "x", 7), (2, "", None, None), (3, "lamora bega", None, None), (3, "lamora bega", None, None), (None, "an idiot", None, None), (5, "bamo " * 100_000 + "moron", None, None)]
    out = toxicity.predict(spark.createDataFrame(odd, SCHEMA), model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert {r["doc_id"]: r["predicted"] for r in out} == {1: 0, 2: 0, 3: 0, None: 1, 5: 1}
    assert toxicity.predict(spark.createDataFrame([], SCHEMA), model).count() == 0
    for few in ([], [("a b", 0)], [("a b", 1)], [("a", 1), ("b", 0)]):
        assert 0 <= toxicity.train(few).score("text") <= 1


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(out[i]["score"], y) for i, y in truth.items() if out[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.75  # some forty toxic documents to learn from, of four languages
