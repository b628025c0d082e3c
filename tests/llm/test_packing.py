import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from comboscan.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, tier string, start long"


def ids(tok, text):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, packing.EOS], dtype="<u4")


def test_round_trip_and_padding(spark):
    rnd = random.Random(3)
    tok = Tokenizer.from_file(PATH)
    rows = [(i, " ".join(rnd.choice(["alpha", "béta", "x1", "\n\n", "  gap ", "don't", "日本"]) for _ in range(rnd.choice([0, 1, 30, 400, 3000]))), None, None) for i in range(300)]
    rows += [(900, None, None, None), (901, "", None, None), (None, "null id", None, None), rows[5], rows[5], (2**60 + 1, "big id", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = packing.pack(df, PATH).collect()
    want = defaultdict(int)
    for i, t, *_ in rows:
        want[i, zlib.crc32(ids(tok, t).tobytes()), len(ids(tok, t))] += 1
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    texts = {(i, len(ids(tok, t))): ids(tok, t) for i, t, *_ in rows}
    for key, pieces in by_doc.items():
        copies = sum(v for (i, _, n), v in want.items() if (i, n) == key)
        whole = texts[key]
        assert sum(n for _, n, _ in pieces) == copies * len(whole)
        for start, n, crc in pieces:
            assert crc == zlib.crc32(whole[start : start + n].tobytes())
    assert {k for k in by_doc} == {(i, n) for (i, _, n) in want}
    steps = defaultdict(set)
    for r in out:
        steps[r["step_group"], r["tier"]].add(r["sequence_id"])
    assert all(len(v) * t <= packing.STEP for (_, t), v in steps.items())
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z1.'\n\t\xa0é日 <|endoftext|>", max_size=40), max_size=6))
def test_ranks_give_the_ids_of_the_file(texts):
    enc = packing.encoder(PATH)
    tok = enc.tokenizer
    assert enc.ranked is not None
    got = enc.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packer_keeps_every_token(lengths):
    p = packing.Packer()
    windows = p.pack([(n, d, 0) for d, n in enumerate(lengths)]) + p.rest()
    seen = defaultdict(list)
    for size, w in windows:
        assert sum(x[0] for x in w) == size
        for n, d, s in w:
            seen[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(seen[d]):
            assert s == at
            at += m
        assert at == n


def test_long_runs_and_every_plane_give_the_ids_of_the_file():
    enc, tok = packing.encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["ab" * 20_000, " " * 50_000 + "x", "\n" * 20_000, "1" * 20_000, "Щ" * 20_000, "<|endoftext|>" * 50]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}. {chr(c)}" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
