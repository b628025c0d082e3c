import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import sentencepiece as spm
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from comboscan.llm import pieces as P
from comboscan.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " ▁ab éß漢字\n\t\0<s>0x0A😀 ́‍Ａﬁ①½<0x0A>�  hello"
SP = spm.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=60))
def test_ids_spans_and_text_are_the_librarys(text):
    own = P.pieces(PATH)
    got, want = own.encode(text), SP.encode(text, return_type="proto")
    assert got.ids.tolist() == [p.id for p in want.pieces]
    assert list(zip(got.begins.tolist(), got.ends.tolist())) == [(p.begin, p.end) for p in want.pieces]
    assert own.decode(own.framed(got.ids)) == SP.decode(own.framed(got.ids).tolist())


def test_any_ids_decode_as_in_the_library():
    own, rnd = P.pieces(PATH), random.Random(4)
    pool = [0, 1, 2, *range(3, 259), *range(259, 32000, 97), 29871, 29871]
    for _ in range(3000):
        ids = [rnd.choice(pool) for _ in range(rnd.randrange(12))]
        assert own.decode(np.array(ids, "<u4")) == SP.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_character_maps_normalise_with_the_librarys_offsets(rule, squeeze):
    lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = proto.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
    own, rnd = P.Normalizer(P.read_charsmap(spec.precompiled_charsmap), True, squeeze, True), random.Random(7)
    letters = LETTERS + "".join(map(chr, [*range(0x300, 0x370), *range(0xFF00, 0xFFEF)])) + "カ゛가각　\xa0​\rﷺ" + " " * 6
    for _ in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(20)))
        norm, places = own(text)
        want, offsets = lib.normalize(text, with_offsets=True)
        assert norm == want
        raw = text.encode()
        starts = [len(norm[:i].encode()) for i in range(len(norm) + 1)]
        assert [len(raw[: int(places[s])].decode(errors="ignore")) for s in starts] == list(offsets)


def test_short_and_long_chunks_merge_alike(monkeypatch):
    own, rnd = P.Pieces(PATH), random.Random(2)
    words = ["▁" + "".join(rnd.choice("abeinrst") for _ in range(rnd.randrange(1, 60))) for _ in range(300)] + ["▁" * n for n in range(1, 40)]
    short = [own._merge_short(list(w)) for w in words]
    monkeypatch.setattr(P, "SHORT", 0)
    assert [own.merge(w) for w in words] == short


def test_whole_texts_with_odd_rows(spark):
    schema = "doc_id long, text string, ids string, _text int"
    rows = [(1, "Grüße, 世界!  two  spaces", "mine", 7), (2, None, None, None), (3, "", "x", 1), (None, "null id", None, None), (1, "Grüße, 世界!  two  spaces", "mine", 7), (4, "long " * 300_000 + "x" * 50_000, None, None)]
    out = P.encode(spark.createDataFrame(rows, schema), PATH).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "ids", "_text", "ids_", "begins", "ends", "decoded"}
    for r in out:
        ids = np.frombuffer(r["ids_"], "<u4").tolist()
        assert ids == [1, *SP.encode(r["text"] or ""), 2] and r["decoded"] == SP.decode(ids) == (r["text"] or "")
        begins, ends = (np.frombuffer(r[k], "<u4") for k in ("begins", "ends"))
        raw = (r["text"] or "").encode()
        assert len(begins) == len(ends) == len(ids) and b"".join(raw[b:e] for b, e in zip(begins, ends)) == raw
    assert sorted((r["ids"], r["_text"]) for r in out if r["ids"]) == [("mine", 7), ("mine", 7), ("x", 1)]
    assert P.encode(spark.createDataFrame([], schema), PATH).count() == 0


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in queries.op13(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = [1, *SP.encode(d["text"] or ""), 2]
        r = out[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
