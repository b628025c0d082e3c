import math
import random

import public_tokenizers
import regex

from comboscan.llm import tokencount

SCHEMA = "doc_id long, text string, tokens string, pre_tokens string"
VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


def viterbi(raw, scores, longest):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(raw)
    for i in range(1, len(raw) + 1):
        best[i] = max((best[j][0] + scores[raw[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if raw[j:i] in scores)
    return -best[-1][1]


def test_counts_match_plain_viterbi(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join("".join(rnd.choice("abeinrst'é1.\n日") for _ in range(rnd.randrange(1, 14))) for _ in range(30)), None, None) for i in range(60)]
    rows += [(100, None, "x", "y"), (101, "", None, None), (None, "no id", None, None), rows[0], rows[0], (102, "word " * 60_000, None, None)]
    got = tokencount.count_tokens(spark.createDataFrame(rows, SCHEMA), VOCAB, public_tokenizers.PATTERN).collect()
    scores = tokencount.zipf_scores(VOCAB)
    longest = max(map(len, scores))
    want = []
    for i, t, *_ in rows[:-1]:
        parts = regex.findall(public_tokenizers.PATTERN, t or "")
        assert "".join(parts) == (t or "")
        want.append((i, len(parts), sum(viterbi(p.encode(), scores, longest) for p in parts)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got if r["doc_id"] != 102), key=key) == sorted(want, key=key)
    assert [r["tokens"] for r in got if r["doc_id"] == 102][0] >= 60_000
    assert tokencount.count_tokens(spark.createDataFrame([], SCHEMA), VOCAB, public_tokenizers.PATTERN).count() == 0


def test_a_reset_trie_counts_the_same():
    scores = tokencount.zipf_scores(VOCAB)
    t = tokencount.Trie(scores)
    words = [" the", " there", " then", " th", "x", " the"]
    first = [t[w] for w in words]
    nodes = len(t.best)
    assert nodes < 1 + sum(map(len, set(words)))  # shared prefixes are nodes once
    t.reset()
    assert [t[w] for w in words] == first and len(t.best) == nodes


def test_long_pre_tokens_are_scored_without_nodes():
    scores = tokencount.zipf_scores(VOCAB)
    t, longest, rnd = tokencount.Trie(scores), max(map(len, scores)), random.Random(8)
    for n in (tokencount.LONG, tokencount.LONG + 1, 3 * tokencount.LONG):
        word = "".join(rnd.choice("abeinrst-=") for _ in range(n))
        nodes = len(t.best)
        assert t[word] == viterbi(word.encode(), scores, longest)
        assert len(t.best) == nodes or n <= tokencount.LONG
    assert t["=" * 100_000] == viterbi(b"=" * 100_000, scores, longest)
