import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece as spm
from tokenizers import Tokenizer

from comboscan.llm import align as A
from comboscan.llm import queries
from comboscan.llm.packing import byte_letters

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_force(texts):
    """Per row: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by loops over every token of every text."""
    tok, sp = Tokenizer.from_file(BYTE_BPE), spm.SentencePieceProcessor(model_file=PIECE_BPE)
    tok.encode_special_tokens = True
    byte = {c: b for b, c in byte_letters().items()}
    a_bytes = {i: bytes(byte[c] for c in s) for s, i in tok.get_vocab().items() if all(c in byte for c in s)}
    b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in range(sp.get_piece_size()) for p in [sp.id_to_piece(i)]]

    def intervals(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(size[i])))
            at += len(size[i])
        return out

    rows, held = [], Counter()
    for t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            rows.append(((0, 0, 0, 0), Counter(), ""))
            continue
        left, right = intervals(a, a_bytes), intervals(b, b_bytes)
        cuts = sorted({x[2] for x in left} & {x[2] for x in right})
        groups, low = [], 0
        for c in cuts:
            inside = lambda side: ",".join(str(x[0]) for x in side if low <= x[1] and x[2] <= c)  # noqa: E731, B023
            groups.append(f"{inside(left)}|{inside(right)}")
            low = c
        links = Counter((x[0], y[0]) for x in left for y in right if x[1] < y[2] and y[1] < x[2])
        held.update(links.keys())
        rows.append(((len(a), len(b), len(groups), sum(links.values())), links, ";".join(groups)))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [(*n, sum(k for p, k in links.items() if held[p] == top[p[0]]), sum(k * held[p] for p, k in links.items()), g) for n, links, g in rows]


def test_odd_rows_against_loops(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2000)
    texts = ["Grüße an die Welt, 世界!", None, "", "a ▁ b is not spelled alike", "<|endoftext|> <s> plain", "the the the them", "Grüße an die Welt, 世界!", "  two  spaces\n\ttab", "don't stop 12345 \x00", "é́" * 30, "word " * 1200]
    texts += [f"the {w} of {w}s" for w in ("cat", "dog", "house", "xqzj") for _ in range(4)]
    rows = [(None if i == 3 else i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, block string").repartition(3)
    out = A.align(df, BYTE_BPE, PIECE_BPE)
    assert out.columns == ["doc_id", "n_a", "block", "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r["n_a"]: tuple(r)[3:] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)
    assert A.align(df.where("false"), BYTE_BPE, PIECE_BPE).count() == 0


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs = {d["doc_id"]: d["text"] for d in docs}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.op12(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, want in zip(docs, brute_force(docs.values())):
        assert got[i] == (*want[:6], hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
