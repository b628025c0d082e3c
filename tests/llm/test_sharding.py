import zlib
from collections import defaultdict

from comboscan.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_key_law_slots_and_edge_rows(spark):
    rows = [(i, f"text {i}" * (i % 7), "clash", 1) for i in range(3000)] + [(None, None, None, None)] * 40 + [(5, "é", None, 2)] * 3 + [(9, "x" * 300_000, "", 0)]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40 and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out)
    raw = lambda t: (t or "").encode()
    assert got == sorted((i if i is not None else -1, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in rows)
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1
    moved = sum(r["grown_shard"] == 40 for r in out)
    assert 20 < moved < 200
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_a_weight_moves_only_its_subtree(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    a = sharding.place(df, df["doc_id"], sharding.topology(40), "a_")
    b = sharding.place(a, a["doc_id"], sharding.topology(40, {7: 3.0}), "b_").collect()
    assert all(r["a_shard"] == r["b_shard"] or r["b_shard"] == 7 for r in b)
    share = sum(r["b_shard"] == 7 for r in b) / len(b)
    assert abs(share - 3 / 42) < 0.01
    assert all(r["b_region"] == r["b_shard"] % 4 and r["b_rack"] == r["b_shard"] // 4 % 2 for r in b)
