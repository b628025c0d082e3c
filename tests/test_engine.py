import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.operators import backtest as B
from comboscan.operators import catalog as K
from comboscan.operators import combos as X
from comboscan.operators import features as FE
from comboscan.operators import kernels as N
from comboscan.operators import metrics as M
from comboscan.operators import search as Q
from comboscan.operators import targets as T
from comboscan.plans import run as R
from comboscan.plans.config import Config, resolve
from comboscan.sources import bars as S
from comboscan.sources import store as ST


def bars(spark, rows, cols="open high low close atr"):
    return spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(rows)], "symbol string, bar_idx long, " + ", ".join(f"{c} double" for c in cols.split()))


@pytest.mark.parametrize("n,k", [(5, 3), (7, 2), (4, 4), (8, 3)])
def test_ranks_follow_the_order(n, k):
    want = [c for d in range(1, k + 1) for c in itertools.combinations(range(n), d)]
    assert [X.unrank(i, n, k) for i in range(X.total(n, k))] == want
    assert [X.rank(list(c), n) for c in want] == list(range(len(want)))
    for a in range(0, len(want), 5):
        assert list(X.walk(a, len(want), n, k)) == want[a:]
    with pytest.raises(IndexError):
        X.unrank(len(want), n, k)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400))
def test_pairs_unrank_in_closed_form(n):
    at = np.arange(math.comb(n, 2))
    i, j = X.unrank_pairs(at, n)
    assert list(zip(i.tolist(), j.tolist())) == list(itertools.combinations(range(n), 2))


def test_large_ranks_round_trip():
    n, k = 10_000, 3
    at = X.total(n, k) // 2
    assert X.rank(list(X.unrank(at, n, k)), n) == at
    assert X.total(5000, 10) > 2**64


@pytest.mark.parametrize("rows,name,side,want", [
    ([(100, 101, 98, 101, 2), (101, 106, 100, 105, 2), (105, 106, 104, 105, 2)], "highlow_1r", 1, (1.0, True, 1)),
    ([(100, 101, 98, 101, 2), (97, 99, 96, 98, 2), (98, 99, 97, 98, 2)], "highlow_1r", 1, (-4 / 3, False, 1)),
    ([(100, 101, 98, 101, 2), (101, 110, 90, 105, 2), (98, 99, 97, 98, 2)], "2x_atr_tp_atr_stop", 1, (-1.0, False, 1)),
    ([(100, 101, 98, 99, 2), (99, 99.5, 94, 95, 2)], "2x_atr_tp_atr_stop", -1, (2.0, True, 1)),
    ([(100, 101, 98, 101, 2), (110, 111, 109, 110, 2)], "atr_tp_atr_stop", 1, (4.5, True, 1)),
])
def test_brackets(spark, rows, name, side, want):
    b = bars(spark, rows)
    s = T.levels(b, T.BRACKETS[name]).where("entry_idx = 0")
    for got in (T.resolve(s, b), T.resolve_join(s, b, 5)):
        r = got.first()
        assert (r["side"], round(r["rr"], 9), r["hit"], r["exit_idx"]) == (side, round(want[0], 9), *want[1:])


def test_doji_and_cutoff(spark):
    b = bars(spark, [(100, 101, 99, 100, 1), (100, 101, 99.5, 100.5, 5), (100.5, 101, 100, 100.6, 5), (100, 120, 99, 119, 5)])
    s = T.levels(b, T.BRACKETS["atr_tp_atr_stop"])
    assert s.where("entry_idx = 0").count() == 0
    forced = T.resolve(s.where("entry_idx = 1"), b, cutoff=2).first()
    assert (forced["exit_idx"], forced["hit"]) == (2, False) and abs(forced["rr"] - 0.1 / 5) < 1e-9
    df = T.with_bracket(b, "atr_stop", "long")
    assert df.columns[-4:] == ["2x_atr_tp_atr_stop", "rr_2x_atr_tp_atr_stop", "2x_atr_tp_atr_stop_exit_i", "2x_atr_tp_atr_stop_eligible"]


def test_recurrences():
    v = np.array([1.0, 2, 3, 4, 5])
    assert np.allclose(N.ema(v, 3), [np.nan, np.nan, 2, 3, 4], equal_nan=True)
    assert np.allclose(N.rma(np.array([np.nan, 2, np.nan, 4]), 2), [np.nan, 2, 2, 3], equal_nan=True)
    level, inn = N.kalman(v, 0.01, 0.1)
    assert inn[0] == 0 and level[0] == 1 and 1 < level[1] < 2
    assert np.all(N.rsi(v, 2)[1:] == 100) and N.rsi(v[::-1].copy(), 2)[-1] == 0
    c = np.cumsum(np.random.default_rng(0).normal(size=300)) + 100
    line, signal, hist = N.macd(c)
    assert np.isnan(line[:25]).all() and np.isfinite(line[25:]).all() and np.isnan(signal[:33]).all() and np.isfinite(hist[33:]).all()
    a = N.adx(c + 1, c - 1, c)
    assert ((a >= 0) & (a <= 100)).all()


def test_rich_columns_are_all_there(spark):
    rng = np.random.default_rng(1)
    c = np.cumsum(rng.normal(size=260)) + 500
    o = np.concatenate([c[:1], c[:-1]])
    rows = list(zip(o, np.maximum(o, c) + 1, np.minimum(o, c) - 1, c))
    out = FE.rich_features(bars(spark, rows, "open high low close")).toPandas().sort_values("bar_idx")
    assert set(K.FLAGS) | set(K.OPERATORS) <= set(out.columns)
    flags = [x for x in out.columns if out[x].dtype == bool]
    assert len(flags) == 124
    assert out.iloc[210:][list(K.OPERATORS)].notna().all().all()
    assert np.allclose(out["200sma"].iloc[-1], c[-200:].mean()) and np.allclose(out["bb_std"].iloc[-1], c[-20:].std(ddof=1))
    assert (out["is_green"] == (c > o)).all()
    entries = K.rich_catalog(spark.createDataFrame(out), with_pairs=True)
    cats = [e.category for e in entries]
    assert cats == sorted(cats, key=["boolean", "feature_vs_constant", "feature_vs_feature"].index)


def test_entry_expressions(spark):
    df = spark.createDataFrame([(True, 2.0, 1.0), (False, 2.0, 3.0), (None, float("nan"), 1.0)], "f boolean, a double, b double")
    n = lambda e: df.where(C.parse_entry(e, df.columns)).count()
    assert [n("f"), n("a > 1.5"), n("a >= b"), n("a == 2"), n("a != 2"), n("a ~ 2"), n("f && a > b")] == [1, 2, 1, 2, 0, 0, 1]
    for bad in ("a >", "zzz", "a > zzz"):
        with pytest.raises(ValueError):
            C.parse_entry(bad, df.columns)


def test_thresholds():
    assert K.nice(-0.1, True) == pytest.approx(-0.1) and K.nice(1.7, False) == 2 and K.nice(0, True) == 0 and K.nice(37, True) == 20
    assert K.increment(-0.1, 2.0, 2) == 0.5
    assert K.grid(0, 1, 0.5, ">") == [0, 0.5] and K.grid(0, 1, 0.5, "<=") == [0, 0.5, 1]
    assert [K.label(x) for x in (1.5, 2.0, -0.001, 0.25)] == ["1.5", "2.0", "-0.0", "0.25"]
    assert len(K.pairs(["a", "b", "c"])) == 6 and len(K.pairs(["a", "b", "c"], ordered=False)) == 3
    assert [e.name for e in K.pairs(["x", "close", "y"], ordered=False, partners={})] == ["x>close", "close>y"]
    assert [p for p in itertools.combinations(range(3), 2) if X.structurally_sound(p, [X.Predicate("a>1", "a", ">"), X.Predicate("a>2", "a", ">"), X.Predicate("a<3", "a", "<")])] == [(0, 2), (1, 2)]


def test_statistics(spark):
    t = spark.createDataFrame([("c", "s", i, r, r > 0, None) for i, r in enumerate([-0.5, 1.0, 0.0, 2.0, -1.0, -1.0])], "combination string, symbol string, bar_idx long, rr double, label boolean, exit_i long")
    s = M.core_stats(t).first()
    assert (s["total_bars"], s["profitable_bars"], s["unprofitable_bars"], s["total_return"], s["max_drawdown"]) == (6, 2, 3, 0.5, 2.0)
    f = M.full_stats(t).first()
    assert f["profit_factor"] == 3 / 2.5 and f["max_loss_streak"] == 2 and f["max_win_streak"] == 1 and f["median_rr"] == -0.25 and f["p95_rr"] == 2 and f["p05_rr"] == -1
    one = t.where("bar_idx = 1").withColumn("rpc", F.lit(100.0))
    e = M.equity(one, M.Sizing("contracts", 10_000, 10, margin=2500), "rpc").first()
    assert e["final_capital"] == 10_400 and e["calmar_ratio"] == float("inf")
    assert M.equity(one, M.Sizing(capital=1000, risk_pct=10)).first()["final_capital"] == pytest.approx(1100)


def test_no_stacking_agrees(spark):
    rng = np.random.default_rng(3)
    hits = np.flatnonzero(rng.random(400) < 0.4)
    exits = np.arange(400) + rng.integers(-1, 6, 400)
    want = X.no_stacking(hits, exits)
    t = spark.createDataFrame([("c", "s", int(i), 1.0, True, int(exits[i])) for i in hits], "combination string, symbol string, bar_idx long, rr double, label boolean, exit_i long")
    assert sorted(r["bar_idx"] for r in M.without_stacking(t).collect()) == want.tolist()


def test_backtest_passes_over_gaps():
    n = float("nan")
    pdf = pd.DataFrame({"symbol": "s", "bar_idx": range(5), "high": [1, n, 1.2, 3, 1], "low": [1, n, 0.9, 0.9, 1], "close": [1, n, 1, 2, 1.0], "period": 0, "entry_long": [True] + [False] * 4, "stop_long": 0.5, "tp_long": 2.5})
    ((_, side, a, b, *_, rr, _, _, _),) = [x[:4] + x[4:6] + (x[6],) + x[7:] for x in B.simulate(pdf, 1, 2, False)]
    assert (side, a, b, rr) == ("long", 0, 3, 3.0)


def test_sources(spark, tmp_path):
    csv = tmp_path / "b.csv"
    csv.write_text("timestamp,open,high,low,close,volume\n2024-01-01T10:00:00Z,1,2,0.5,1.5,10\n2023-12-31T10:00:00Z,x,2,1,1,7\n")
    b = S.read_bars(spark, str(csv))
    assert [(r["bar_idx"], r["open"]) for r in b.orderBy("bar_idx").collect()] == [(0, None), (1, 1.0)]
    assert S.date_filter(b, "2024-01-01", None, "timestamp").count() == 1
    assert S.fingerprint(spark, str(csv)).startswith("raw:")
    path = f"{tmp_path}/prep"
    assert S.write_prepared(b, path) and not S.write_prepared(b, path)
    with pytest.raises(S.ChangedDataError):
        S.write_prepared(b.where("bar_idx = 0"), path)
    assert S.write_prepared(b.where("bar_idx = 0"), path, acknowledge=True)
    r = spark.createDataFrame([(5, 2)], "t_exit_i long, x long")
    assert S.rebase_exits(r, 6).first()["t_exit_i"] is None and S.rebase_exits(r, 2).first()["t_exit_i"] == 3
    assert ST.parse_s3("s3://bucket/a/b/") == ("bucket", "a/b")
    with pytest.raises(ValueError):
        ST.parse_s3("s3:///x")


def test_search_resumes_and_ranks(spark, tmp_path):
    rng = np.random.default_rng(5)
    c = np.cumsum(rng.normal(size=150)) + 100
    o = np.concatenate([c[:1], c[:-1]])
    rows = [("ALL", i, float(o[i]), float(max(o[i], c[i]) + rng.random()), float(min(o[i], c[i]) - rng.random()), float(c[i]), float(rng.integers(1, 50))) for i in range(150)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, volume double")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("bar_idx") * 3600))
    cfg = Config("x", f"{tmp_path}/out", min_samples=5, batch=20, max_combos=20, top=3, max_drawdown=1e9)
    first = R.run(spark, df, cfg, "raw:1")
    n1 = spark.table("results").count()
    assert first.count() == 3 and n1 > 0
    from dataclasses import replace

    R.run(spark, df, replace(cfg, max_combos=None), "raw:1")
    res = spark.table("results")
    assert res.count() > n1 and res.select("combination").distinct().count() == res.count()
    with pytest.raises(ST.OtherDataError):
        R.run(spark, df, cfg, "raw:2")
    assert R.run(spark, df, replace(cfg, dry_run=True), "raw:1") is None
    cal = [r["calmar_ratio"] for r in ST.top_results(res, 3, 5).collect()]
    assert cal == sorted(cal, reverse=True)


def test_config():
    c = resolve("comb --data a.csv --out o --target atr_stop --sizing contracts --asset mes".split())
    assert (c.target, c.stop_column, c.sizing.margin, c.point_value) == ("2x_atr_tp_atr_stop", "atr", 2500.0, 5.0)
    with pytest.raises(ValueError):
        resolve("comb --data a.csv --out o --sizing contracts".split())


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    from comboscan.streaming.bars import streaming_bars

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"{tmp_path}/in")
    stream = streaming_bars(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["symbol"], r["ts"]): (r["open"], r["close"], r["volume"]) for r in spark.table("bars_out").collect()}
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["symbol"], r["ts"]): (r["open"], r["close"], r["volume"]) for r in S.bars_from_events(src, "hour", F.col("event_type")).collect()}
    assert len(got) > 100 and all(want[k] == v for k, v in got.items())


def test_reports_tuner_and_table_function(spark):
    from comboscan.plans import report

    top = spark.createDataFrame([("a && b", 1.5, 7)], "combination string, calmar_ratio double, total_bars long")
    assert report.format_report(top) == "1. a && b\n   calmar_ratio: 1.5000\n   total_bars: 7"
    assert report.format_report(top, True) == "1. a && b"
    t = report.BatchTuner(1000)
    assert [t.record(1.0) for _ in range(10)][-1] == 2000 and [t.record(100.0) for _ in range(20)][-1] == 1000
    report.register(spark)
    got = spark.sql("SELECT * FROM enumerate_combos(4, 2, 3, 7) ORDER BY combo_id").collect()
    assert [(r["combo_id"], r["combo"]) for r in got] == [(3, [3]), (4, [0, 1]), (5, [0, 2]), (6, [0, 3])]
    df = spark.createDataFrame([("s", i, i % 2 == 0, i < 3, i > 5) for i in range(8)], "symbol string, bar_idx long, a boolean, b boolean, c boolean")
    dead = report.dead_pairs(X.mask_words(df, ["a", "b", "c"]), 3, 2).collect()
    assert sorted((r["a"], r["b"]) for r in dead) == [(0, 2), (1, 2)]


def packed(spark, flags, reward, label, exits, rpc=None, gate=None, symbol="s", base=0):
    """Blocks of plain arrays, bars numbered from ``base``."""
    n = flags.shape[1]
    pdf = pd.DataFrame({"symbol": symbol, "bar_idx": np.arange(n) + base, "t": label, "rr_t": reward, "t_eligible": np.ones(n, bool) if gate is None else gate, "t_exit_i": exits + base, "rpc": np.ones(n) if rpc is None else rpc})
    names = [f"{'f' if rpc is None else 'p'}{i}" for i in range(len(flags))]
    pdf = pd.concat([pdf, pd.DataFrame(dict(zip(names, flags)))], axis=1)
    return Q.pack(spark.createDataFrame(pdf), names, "t", rpc=F.col("rpc"))


def test_search_honours_its_prunes(spark):
    rng = np.random.default_rng(7)
    flags = rng.random((5, 200)) < 0.5
    exits = np.arange(200) + 3
    a = packed(spark, flags, rng.normal(size=200), flags[0], exits)
    preds = [X.Predicate(f"f{i}") for i in range(5)]
    names = lambda dead=None, **k: {r["combination"] for r in Q.search(a, preds, 3, min_sample=5, parts=3, dead=dead, **k).collect()}
    every = names()
    assert "f0 && f1 && f2" in every and "f0" in every
    assert names(require_any={"f4"}) == {x for x in every if "f4" in x}
    assert every - names(dead=Q.pair_bits(spark.createDataFrame([(0, bytearray([128]))], "i long, bits binary"), 5)) == {x for x in every if x.startswith("f0 && f1 && ")}
    one = Q.search(a, preds, 1, 0, 1, stacking=False).first()
    hits = X.no_stacking(np.flatnonzero(flags[0]), exits)
    assert one["total_bars"] == len(hits) and one["mask_hits"] == flags[0].sum()
    with pytest.raises(ValueError):
        Q.search(a, preds, 2, require_any={"zz"})


def test_scratch_tables_are_shared_and_dropped(spark):
    from comboscan import session

    df = session.materialize(spark.range(5), "x")
    assert df.count() == 5 and session.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    session.drop_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


@pytest.mark.parametrize("n,k,need", [(5, 3, 1), (7, 2, 30), (9, 4, 20), (8, 4, 1), (4, 4, 1)])
def test_the_descent_finds_what_plain_ands_find(n, k, need):
    rng = np.random.default_rng(n)
    flags = rng.random((n, 192)) < 0.5
    masks = np.packbits(flags, axis=1, bitorder="little").view("<u8")
    gate = np.packbits(rng.random(192) < 0.8, bitorder="little").view("<u8")
    rules = Q.Rules(np.array([0, 0, 1, *[-1] * (n - 3)]), np.zeros(n, bool), None)
    whole = list(X.walk(0, X.total(n, k), n, k))
    for a, b in ((0, len(whole)), (3, len(whole) - 1), (len(whole) - 1, len(whole)), (2, 2), (5, min(17, len(whole)))):
        got, looked = {}, None
        for ranks, members, words, count in Q.descend(masks, gate, k, a, b, need, rules):
            if len(ranks):
                got |= {int(r): (tuple(m), int(c), w.tobytes()) for r, m, c, w in zip(ranks, members.tolist(), count, words)}
            else:
                looked = int(count[0])
        want = {}
        for r in range(a, b):
            w = np.bitwise_and.reduce(masks[list(whole[r])], axis=0) & gate
            c = int(np.bitwise_count(w).sum())
            if c >= need and not {0, 1} <= set(whole[r]):
                want[r] = (whole[r], c, w.tobytes())
        assert got == want
        assert a > 0 or looked <= sum(math.comb(n, j) for j in range(1, k + 1)) * 2


def test_dead_prefixes_take_their_ranks_with_them():
    rng = np.random.default_rng(0)
    flags = rng.random((60, 640)) < 0.2
    masks = np.packbits(flags, axis=1, bitorder="little").view("<u8")
    rules = Q.Rules(np.full(60, -1), np.zeros(60, bool), None)
    every = list(Q.descend(masks, np.full(10, 2**64 - 1, "<u8"), 4, 0, X.total(60, 4), 20, rules))
    assert every[-1][3][0] < X.total(60, 4) / 7  # pairs have some 26 common bars, triples 5
    pairs = sum(int((flags[i] & flags[j]).sum() >= 20) for i, j in itertools.combinations(range(60), 2))
    assert sum(len(x[0]) for x in every if x[0].size and x[1].shape[1] == 2) == pairs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=12), st.lists(st.integers(-40, 40), min_size=1, max_size=12), st.lists(st.integers(-40, 40), min_size=1, max_size=12))
def test_summaries_combine_in_any_grouping(*rewards):
    def summary(r):
        words = np.packbits(np.ones(64, bool)[None, :] * (np.arange(64) < len(r)), axis=1, bitorder="little").view("<u8")
        seg = Q.Segment({"block": 0, "size": 64, "flags": words.tobytes(), "gate": words.tobytes(), "label": words.tobytes(), "reward": np.array([*r, *[0.0] * (64 - len(r))]).tobytes(), "exits": np.zeros(64, "<i8").tobytes(), "rpc": np.ones(64).tobytes()}, 1, 64)
        return Q.judge(seg, words, np.array([len(r)]), True, X.Capital(risk=0.01))

    a, b, c = (summary([x / 4 for x in r]) for r in rewards)
    whole = summary([x / 4 for r in rewards for x in r])
    for s in (Q.combine(Q.combine(a, b), c), Q.combine(a, Q.combine(b, c))):
        assert all(np.allclose(s[k], whole[k]) for k in ("n", "wins", "label", "sum", "high", "low", "fall", "growth", "top", "bottom", "pct"))


@pytest.mark.parametrize("mode,stacking,block", [(m, s, b) for m in ("fractional", "contracts") for s in (True, False) for b in (1 << 16, 64)])
def test_statistics_of_blocks_match_plain_loops(spark, monkeypatch, mode, stacking, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = np.random.default_rng(11)
    n, rows = 6, 130
    r = rng.normal(size=rows)
    r[rng.random(rows) < 0.1] = np.nan
    flags, gate, label, exits, rpc = rng.random((n, rows)) < 0.5, (rng.random(rows) < 0.9) & np.isfinite(r), rng.random(rows) < 0.5, np.arange(rows) + rng.integers(0, 5, rows), rng.uniform(500, 900, rows)
    a = packed(spark, flags, r, label, exits, rpc, gate, base=7)
    assert a.deepest == (1 if block > rows else 3)
    sizing = M.Sizing(mode, 100_000.0, 1.0, 1000.0, 1, 3, 20_000.0)
    cap = X.Capital(0.01, 100_000.0, 2.0, mode == "contracts", 1, 3, 20_000.0)
    got = {x["combination"]: x for x in Q.search(a, [X.Predicate(f"p{i}") for i in range(n)], 3, stacking=stacking, min_sample=10, capital=cap).collect()}
    trades, seen = [], 0
    for c in X.walk(0, X.total(n, 3), n, 3):
        hits = np.flatnonzero(flags[list(c)].all(axis=0))
        name, mask = " && ".join(f"p{i}" for i in c), len(hits)
        hits = hits[gate[hits]]
        hits = hits if stacking else X.no_stacking(hits, exits)
        if len(hits) < 10:
            assert name not in got
            continue
        x, eq = got[name], np.cumsum(r[hits])
        assert (x["mask_hits"], x["total_bars"], x["profitable_bars"], x["label_hits"]) == (mask, len(hits), (r[hits] > 0).sum(), label[hits].sum())
        assert np.isclose(x["total_return"], eq[-1]) and np.isclose(x["max_drawdown"], (np.maximum(np.maximum.accumulate(eq), 0) - eq).max())
        trades += [(name, "s", int(i), float(r[i]), float(rpc[i])) for i in hits]
        seen += 1
    assert seen == len(got) > 20
    path = M.equity(spark.createDataFrame(trades, "combination string, symbol string, bar_idx long, rr double, rpc double"), sizing, "rpc" if mode == "contracts" else None, 2.0)
    for x in path.collect():
        assert np.isclose(x["calmar_ratio"], got[x["combination"]]["calmar_ratio"])


def test_costs_and_bounds_of_the_command_line():
    base = ["comb", "--data", "d", "--out", "o"]
    assert resolve([*base, "--asset", "es"]).cost_r == pytest.approx(4.5 / 1000)
    assert resolve([*base, "--asset", "ES", "--commission", "10", "--slippage", "5"]).cost_r == pytest.approx(15 / 1000)
    assert resolve([*base, "--cost", "7", "--dollars-per-r", "70"]).cost_r == pytest.approx(0.1) and resolve(base).cost_r == 0
    c = resolve([*base, "--asset", "MES", "--sizing", "contracts", "--target", "atr_stop"])
    assert c.cost_r == pytest.approx(1.14) and c.tick == 0.25 and c.sizing.margin == 2500
    with pytest.raises(ValueError):
        resolve([*base, "--sizing", "contracts"])


def test_state_survives_a_lost_write_and_gaps_are_not_skipped(spark, tmp_path):
    s = ST.Store(spark, f"{tmp_path}/s", "d", "r" * 20)
    for a, b in ((0, 10), (20, 30), (10, 15)):
        s.state["runs"].setdefault(s.run, []).append([a, b])
        s._save()
    assert s.offset() == 15
    newest = max((tmp_path / "s").glob("state-*.json"))
    newest.write_text('{"data": "d", "ru')  # cut short
    for crc in (tmp_path / "s").glob(".*.crc"):
        crc.unlink()
    again = ST.Store(spark, f"{tmp_path}/s", "d", "r" * 20)
    assert again.offset() == 10 and again.state["data"] == "d"


def test_dead_pairs_are_kept_and_told_apart(spark, tmp_path):
    rng = np.random.default_rng(2)
    flags = rng.random((9, 300)) < 0.3
    made = []

    def bits(flags, store):
        a = packed(spark, flags, np.ones(300), flags[0], np.arange(300))
        key = ST.run_digest({"masks": S.digest(a.df.select("symbol", "block", "flags", "gate")), "need": 27})
        rows = store.cached("pairs", key, lambda: made.append(key) or Q.dead_pairs(a, 27))
        return np.unpackbits(Q.pair_bits(rows, 9), axis=1, count=9).astype(bool)

    store = ST.Store(spark, f"{tmp_path}/s", "d", "r" * 20)
    want = (flags[:, None, :] & flags[None, :, :]).sum(axis=2) < 27
    np.fill_diagonal(want, False)
    assert (bits(flags, store) == want).all() and want.any() and not want.all() and len(made) == 1
    assert (bits(flags, store) == want).all() and len(made) == 1  # read again
    other = flags.copy()
    other[3] = ~other[3]
    assert not (bits(other, store) == want).all() and len(made) == 2  # other masks, another table


def test_windows_overlap_and_are_named_in_order(spark):
    import threading
    import time

    seen, lock, most = [], threading.Lock(), [0, 0]

    def window(a, b):
        with lock:
            most[0] += 1
            most[1] = max(most)
        time.sleep(0.2 if a == 0 else 0.01)
        if a == 40:
            raise RuntimeError("lost")
        with lock:
            most[0] -= 1
        return 0.0

    with pytest.raises(RuntimeError, match="lost"):
        for a, b, _ in R.in_order(spark, window, 0, 95, lambda: 10, 2):
            seen.append((a, b))
    assert seen == [(0, 10), (10, 20), (20, 30), (30, 40)] and most[1] == 2


def test_profiles_say_what_was_judged(spark):
    from pyspark.sql import Observation

    rng = np.random.default_rng(7)
    flags, seen = rng.random((6, 200)) < 0.5, Observation()
    a = packed(spark, flags, rng.normal(size=200), flags[0], np.arange(200))
    kept = len(Q.search(a, [X.Predicate(f"f{i}") for i in range(6)], 3, min_sample=20, profile=seen).collect())
    assert seen.get["kept"] == kept and kept <= seen.get["looked"] and R.profile_line(0, 41, seen.get, "coarse").endswith(f"{kept} kept")
    assert "s of ANDs" in R.profile_line(0, 41, seen.get, "fine")


@pytest.mark.parametrize("fan,cutoff", [(3, None), (4, 70), (128, 70), (5, 0)])
def test_first_touches_equal_a_scan_to_the_end(spark, monkeypatch, fan, cutoff):
    monkeypatch.setattr(T, "FAN", fan)
    rng = np.random.default_rng(fan)
    rows, want = [], set()
    for sym, n in (("a", 150), ("b", 1), ("c", 37)):
        c = np.cumsum(rng.normal(size=n)) + 100
        o = c + rng.normal(size=n) * 0.3
        h, low = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
        h[rng.random(n) < 0.05] = np.nan
        a = rng.uniform(0.5, 4, n)
        rows += [(sym, i, *(None if np.isnan(x) else float(x) for x in v)) for i, v in enumerate(zip(o, h, low, c, a))]
    b = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, atr double")
    s = T.levels(b, T.BRACKETS["2x_atr_tp_atr_stop"])
    pdf = b.toPandas()
    for r in s.collect():
        x = pdf[pdf["symbol"] == r["symbol"]].sort_values("bar_idx")
        capped = cutoff is not None and r["entry_idx"] <= cutoff
        last = min(cutoff, len(x) - 1) if capped else len(x) - 1
        rr, hit, j = T.first_touch(*(x[k].to_numpy() for k in ("open", "high", "low", "close")), r["entry_idx"], r["side"], r["entry"], r["stop"], r["tp"], last, capped)
        if np.isfinite(rr):
            want.add((r["symbol"], r["entry_idx"], r["side"], round(rr, 9), hit, j))
    got = T.resolve(s, b, cutoff).collect()
    assert {(r["symbol"], r["entry_idx"], r["side"], round(r["rr"], 9), r["hit"], r["exit_idx"]) for r in got} == want and len(got) == len(want) > 10
    assert T.resolve(s.where("false"), b, cutoff).count() == 0


def test_a_run_never_looks_beyond_its_last_day(spark):
    rng = np.random.default_rng(8)
    c = np.cumsum(rng.normal(size=200)) + 500
    o = np.concatenate([c[:1], c[:-1]])
    rows = [("ALL", i, float(o[i]), float(max(o[i], c[i]) + 1), float(min(o[i], c[i]) - 1), float(c[i]), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, volume double")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("bar_idx") * 3600))
    for target in ("2x_atr_tp_atr_stop", "highlow_1r"):
        p = R.prepare(spark, df, Config("x", "o", target=target, end="2024-01-04", min_samples=5, tick=0.25)).data
        last = p.agg(F.max("bar_idx")).first()[0]
        assert last == 95 and p.agg(F.max(f"{target}_exit_i")).first()[0] == 95
        stops = T.levels(p, T.BRACKETS[target], 0.25).select(F.max(F.abs(F.col("stop") * 4 - F.round(F.col("stop") * 4)))).first()[0]
        assert stops < 1e-9


def test_results_are_those_the_state_names(spark, tmp_path):
    s = ST.Store(spark, f"{tmp_path}/s", "d", "r" * 20)
    rows = spark.createDataFrame([("d", "long", "t", "a", "now", 0, 1, 9, 5, 50.0, 1.0, 2.0)], ", ".join(f"{c} {t}" for c, t in ST.RESULT_COLUMNS.items()))
    s.commit(rows, 0, 10)
    rows.write.parquet(f"{tmp_path}/s/results/{'r' * 16}/window=0-20")  # written, never named
    assert ST.committed(spark, f"{tmp_path}/s").count() == 1


@pytest.mark.parametrize("missing", [0.0, 0.05])
def test_scans_over_blocks_equal_plain_loops(spark, missing):
    from comboscan.operators import scans as Z

    rng, rows, want = np.random.default_rng(4), [], {}
    for sym, n in (("a", 1000), ("b", 60), ("c", 512), ("d", 1)):
        c = np.cumsum(rng.normal(size=n)) + 300
        o = c + rng.normal(size=n) * 0.3
        price = [o, np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n), c]
        for x in price:
            x[rng.random(n) < missing] = np.nan
        if missing and n > 500:
            c[300:330] = np.nan
        with np.errstate(all="ignore"):
            want[sym] = N.recursive_columns(*price)
        rows += [(sym, i, "kept", *(None if np.isnan(x) else float(x) for x in v)) for i, v in enumerate(zip(*price))]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, block string, open double, high double, low double, close double")
    got = Z.with_recursive_blocks(df.drop("block"), 256).toPandas()
    assert len(got) == len(rows)
    for sym, w in want.items():
        g = got[got["symbol"] == sym].sort_values("bar_idx")
        for k, v in w.items():
            assert np.allclose(v, g[k].to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True), (sym, k)
    assert Z.with_recursive_blocks(df.drop("block").where("false"), 256).count() == 0


def test_long_symbols_are_scanned(spark, monkeypatch):
    from comboscan.operators import scans as Z

    rng = np.random.default_rng(6)
    c = np.cumsum(rng.normal(size=700)) + 300
    df = bars(spark, list(zip(c, c + 1, c - 1, c + rng.normal(size=700))), "open high low close")
    plain = N.with_recursive(df).toPandas().sort_values("bar_idx")
    monkeypatch.setattr(Z, "BLOCK", 256)
    long = N.with_recursive(df).toPandas().sort_values("bar_idx")
    assert all(np.allclose(plain[k], long[k], rtol=1e-9, atol=1e-9, equal_nan=True) for k in N.RECURSIVE)


def test_order_statistics_equal_numpy(spark, monkeypatch):
    from comboscan.operators import order as O

    monkeypatch.setattr(O, "CELLS", 4)
    rng = np.random.default_rng(9)
    n = 500
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.full(n, 7.0), "d": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "e": np.full(n, np.nan)})
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[3, "b"] = np.inf
    df = spark.createDataFrame(pdf).repartition(3)
    qs = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = O.linear_quantiles(df, list("abcde"), qs)
    assert set(got) == set("abcd")
    for k, v in got.items():
        x = pdf[k].to_numpy()
        assert np.allclose(v, np.quantile(x[np.isfinite(x)], qs), rtol=1e-12)
    near = K.nearest_quantiles(df, ["a", "d"], [0.5, 0.75])
    for (k, q), v in near.items():
        x = np.sort(pdf[k][np.isfinite(pdf[k])])
        assert v == x[math.floor((len(x) - 1) * q + 0.5)]
    assert O.linear_quantiles(df.where("false"), ["a"], qs) == {} and O.linear_quantiles(df, [], qs) == {}


def test_average_ranks_share_ties(spark):
    from comboscan.operators import order as O

    rng = np.random.default_rng(10)
    pdf = pd.concat([pd.DataFrame({"symbol": s, "bar_idx": np.arange(n), "x": rng.integers(0, 9, n).astype(float), "y": rng.normal(size=n)}) for s, n in (("a", 300), ("b", 40), ("c", 1))])
    pdf.loc[pdf["bar_idx"] % 11 == 5, "x"] = None
    df = spark.createDataFrame(pdf).repartition(4)
    got = O.with_average_ranks(df, {"rx": C.num("x"), "ry": C.num("y")}, {"q": (C.num("y"), 0.8)}).toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    pdf = pdf.sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    for c in "xy":
        assert np.allclose(got[f"r{c}"], pdf.groupby("symbol")[c].rank(pct=True), equal_nan=True)
    assert np.allclose(got["q"], pdf.groupby("symbol")["y"].transform(lambda v: v.quantile(0.8)))


def test_chains_of_trades_are_doubled(spark):
    rng, rows, want = np.random.default_rng(13), [], set()
    for combo in ("x", "y", "z"):
        n = {"x": 300, "y": 1, "z": 40}[combo]
        hits = np.sort(rng.choice(500, n, replace=False))
        exits = np.zeros(501, int)
        exits[hits] = hits + rng.integers(-2, 9, n)
        rows += [(combo, "s", int(i), 1.0, True, int(exits[i]) if exits[i] > i else None) for i in hits]
        want |= {(combo, int(i)) for i in X.no_stacking(hits, np.where(exits > np.arange(501), exits, -1))}
    t = spark.createDataFrame(rows, "combination string, symbol string, bar_idx long, rr double, label boolean, exit_i long")
    got = M.without_stacking(t)
    assert {(r["combination"], r["bar_idx"]) for r in got.collect()} == want and got.columns == t.columns
    assert M.without_stacking(t.where("false")).count() == 0


def test_live_indicators_equal_the_batch(spark, tmp_path):
    from comboscan.streaming.indicators import COLUMNS, streaming_indicators

    rng, rows, want = np.random.default_rng(15), [], {}
    start = pd.Timestamp("2024-01-01")
    for sym, n in (("a", 260), ("b", 40)):
        c = np.cumsum(rng.normal(size=n)) + 100
        price = [c + rng.normal(size=n) * 0.3, c + 1 + rng.random(n), c - 1 - rng.random(n), c]
        price[1][n // 2] = np.nan  # a missing high
        with np.errstate(all="ignore"):
            want[sym] = N.recursive_columns(*price)
        rows += [(sym, (start + pd.Timedelta(minutes=i)).to_pydatetime(), *(None if np.isnan(x) else float(x) for x in v)) for i, v in enumerate(zip(*price))]
    schema = "symbol string, ts timestamp, open double, high double, low double, close double"
    # three files, each with its bars in any order, and one that moves the watermark past the end
    for k, part in enumerate([[r for r in rows if r[1] < start + pd.Timedelta(minutes=90)], [r for r in rows if start + pd.Timedelta(minutes=90) <= r[1] < start + pd.Timedelta(minutes=91)], [r for r in rows if r[1] >= start + pd.Timedelta(minutes=91)], [("z", (start + pd.Timedelta(days=3)).to_pydatetime(), 1.0, 1.0, 1.0, 1.0)]]):
        order = rng.permutation(len(part))
        spark.createDataFrame([part[i] for i in order], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = streaming_indicators(src, "10 minutes").writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.table("live").toPandas()
    for sym, w in want.items():
        g = got[got["symbol"] == sym].sort_values("ts")
        assert len(g) == len(w["atr"])
        for k in COLUMNS:
            assert np.allclose(g[k].to_numpy(float), w[k], rtol=1e-9, atol=1e-9, equal_nan=True), (sym, k)


def test_damaged_parts_are_named(spark, tmp_path):
    rows = [("d", "long", "t", f"c{i}", "now", 0, 1, 9, 5, 50.0, 1.0, 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in ST.RESULT_COLUMNS.items()))
    s = ST.Store(spark, f"{tmp_path}/s", "d", "r" * 20)
    s.commit(df.coalesce(1), 0, 10)
    s.commit(df.coalesce(1), 10, 20)
    s.commit(df.where("false"), 20, 30)
    assert s.results(check=True).count() == 100 and not (tmp_path / "s/quarantine").exists()
    (part,) = (tmp_path / f"s/results/{'r' * 16}/window=10-20").glob("*.parquet")
    part.write_bytes(part.read_bytes()[:-40])
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert s.results(check=True).count() == 50
    (named,) = spark.read.parquet(f"{tmp_path}/s/quarantine").collect()
    assert named["file"].endswith(part.name) and named["rows_read"] == 0 and named["why"]


def test_audits_and_core_columns(spark):
    df = spark.createDataFrame([(True, 1, 1.0, 0.0, 5.0, None), (False, 0, 2.0, 1.0, 5.5, None)], "is_tribar boolean, odd int, adx double, rsi_14 double, mine double, stray boolean")
    a = K.audit(df)
    assert a.unlisted_flags == ["odd", "stray"] and a.unlisted_numbers == {"mine": (5.0, 5.0, 5.0, 5.5)}
    assert "is_hammer" in a.missing_flags and "macd" in a.missing_numbers and a.not_numbers == ["rsi_14"]
    assert any(x.startswith("number in no catalog: mine") for x in a.lines()) and K.core_columns(df) == ["adx", "rsi_14"]


def test_flags_of_the_command_line():
    base = ["comb", "--data", "d", "--out", "o"]
    c = resolve(base)
    assert (c.depth, c.stacking, c.batch, c.target, c.stats, c.show) == (3, False, 20_000, "next_bar_color_and_wicks", "core", True)
    c = resolve([*base, "--stacking-mode", "stacking", "--asset", "ES", "--no-costs", "--require-any-features", "a,b", "--stop-distance-unit", "ticks", "--report", "off", "--min-samples-report", "9", "--s3-output", "s3://bucket/x"])
    assert c.stacking and c.cost_r == 0 and c.require_any == ("a", "b") and c.stop_unit == "ticks" and not c.show and c.min_samples_report == 9 and c.upload == "s3://bucket/x"
    for bad in (["--stop-distance-unit", "ticks"], ["--s3-output", "bucket"]):
        with pytest.raises(ValueError):
            resolve([*base, *bad])


def test_a_full_report_of_a_rich_run(spark, tmp_path):
    rng = np.random.default_rng(21)
    c = np.cumsum(rng.normal(size=420)) + 500
    o = np.concatenate([c[:1], c[:-1]])
    rows = [("ALL", i, float(o[i]), float(max(o[i], c[i]) + 1), float(min(o[i], c[i]) - 1), float(c[i]), 1.0) for i in range(420)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, volume double")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("bar_idx") * 3600))
    cfg = Config("x", f"{tmp_path}/out", rich=True, target="2x_atr_tp_atr_stop", depth=1, min_samples=20, max_drawdown=1e9, stacking=False, stats="full", keep_prepared=True, subset_pruning=True, profile="fine")
    top = R.run(spark, df, cfg, "raw:1").toPandas()
    assert 0 < len(top) <= 5 and {"sharpe", "quality", "net_profit_dollar", "calmar_ratio"} <= set(top.columns) and (top["total_bars"] >= 20).all()
    assert spark.read.parquet(f"{tmp_path}/out/prepared").agg(F.min("bar_idx")).first()[0] >= 199  # warm-up rows take no part
    stored = spark.table("results").where("depth = 1").toPandas().set_index("combination")
    for r in top.itertuples():
        assert stored.loc[r.combination, "total_bars"] == r.total_bars and np.isclose(stored.loc[r.combination, "calmar_ratio"], r.calmar_ratio)


def test_dates_are_those_written_with_the_time(spark, tmp_path):
    csv = tmp_path / "b.csv"
    csv.write_text("timestamp,open,high,low,close,volume\n2024-03-01T01:30:00+02:00,1,2,0.5,1.5,10\n2024-02-29T23:45:00Z,1,2,0.5,1.6,10\n2024-02-29T20:00:00-05:00,1,2,0.5,1.7,10\nbad,1,2,0.5,1.8,10\n")
    b = S.read_bars(spark, str(csv))
    of = lambda *d: {r["close"] for r in S.date_filter(b, *d, "timestamp").collect()}
    assert of("2024-03-01", None) == {1.5} and of(None, "2024-02-29") == {1.6, 1.7} and len(of(None, None)) == 4
