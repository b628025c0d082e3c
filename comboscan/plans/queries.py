"""Queries over the driver's tables, one for each operator family, with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.operators import backtest as B
from comboscan.operators import catalog as K
from comboscan.operators import combos as X
from comboscan.operators import features as FE
from comboscan.operators import metrics as M
from comboscan.operators import order as O
from comboscan.operators import search as Q
from comboscan.operators import targets as T
from comboscan.operators.kernels import with_recursive
from comboscan.operators.scans import with_recursive_blocks
from comboscan.plans.registry import ORACLES, QUERIES
from comboscan.session import materialize, ship_package
from comboscan.sources import bars as S
from comboscan.sources import store as ST


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/events.parquet")


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return S.bars_from_events(events(spark, sf), "hour", F.col("event_type"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


FLAGS = ["is_green", "is_red", "is_inside_bar", "is_range_expansion", "above_sma9", "above_sma20", "busy", "wide"]


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Bars by event type with eight flags and the next-bar target."""
    df = T.next_bar(FE.builtin_features(by_type(spark, sf)))
    return df.withColumns({
        "above_sma9": C.true(F.col("close") > F.col("sma_9")), "above_sma20": C.true(F.col("close") > F.col("sma_20")),
        "busy": C.true(F.col("volume") > C.lag(F.col("volume"))), "wide": C.true(F.col("abs_body") > 0.5 * F.col("range")),
    })


def _bars(symbol: str) -> str:
    return f"""raw AS (
  SELECT {symbol} AS symbol, date_trunc('hour', e.ts) AS bts, arg_min(e.value, e.ts) AS open, max(e.value) AS high, min(e.value) AS low,
    arg_max(e.value, e.ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events e WHERE e.value IS NOT NULL AND e.ts IS NOT NULL GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bts) - 1 AS bar_idx FROM raw)"""


BARS = "WITH " + _bars("e.event_type")
RBARS = "WITH RECURSIVE " + _bars("e.event_type")
FEATS = """,
f0 AS (SELECT *, close > open AS is_green, close < open AS is_red,
  coalesce(high <= lag(high) OVER w AND low >= lag(low) OVER w, false) AS is_inside_bar, coalesce(high - low > lag(high - low) OVER w, false) AS is_range_expansion,
  CASE WHEN count(*) OVER (w ROWS 8 PRECEDING) = 9 THEN avg(close) OVER (w ROWS 8 PRECEDING) END AS sma_9,
  CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma_20,
  lead(open) OVER w AS no, lead(close) OVER w AS nc, lag(volume) OVER w AS pv
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
feats AS (SELECT *, coalesce(close > sma_9, false) AS above_sma9, coalesce(close > sma_20, false) AS above_sma20, coalesce(volume > pv, false) AS busy,
  abs(close - open) > 0.5 * (high - low) AS wide, no IS NOT NULL AS elig, coalesce(nc > no, false) AS label,
  CASE WHEN no IS NOT NULL THEN CASE WHEN nc > no THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END END AS rr FROM f0)"""
_MASKS = "[" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in FLAGS) + "]"
TRADES = FEATS + f""",
trades AS (SELECT symbol, bar_idx, rr, label, combination FROM (SELECT *, unnest({_MASKS}) AS combination FROM feats) WHERE combination IS NOT NULL AND elig)"""
CURVES = TRADES + """,
c1 AS (SELECT *, sum(rr) OVER w AS equity, sign(rr)::INTEGER AS sgn, lag(sign(rr)) OVER (PARTITION BY combination, symbol ORDER BY bar_idx) AS psgn FROM trades
  WINDOW w AS (PARTITION BY combination, symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
c2 AS (SELECT *, greatest(0, max(equity) OVER w) AS peak, sum(CASE WHEN psgn = sgn THEN 0 ELSE 1 END) OVER w AS streak FROM c1
  WINDOW w AS (PARTITION BY combination, symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
curves AS (SELECT *, peak - equity AS drawdown FROM c2)"""


def flag_trades(spark: SparkSession, sf: str) -> DataFrame:
    df = prepared(spark, sf)
    return M.trades(df, {n: F.col(n) for n in FLAGS}, "next_bar_up", F.col("rr_next_bar_up"))


@query("flagship", "WITH " + _bars("'ALL'") + FEATS + """,
m AS (SELECT bar_idx, rr, n AS name, i AS idx FROM (SELECT *, unnest(['is_green','is_red','is_inside_bar','is_range_expansion']) AS n, unnest([0,1,2,3]) AS i,
  unnest([is_green,is_red,is_inside_bar,is_range_expansion]) AS v FROM feats WHERE elig) WHERE v),
t AS (SELECT bar_idx, rr, name AS combination, 1 AS depth FROM m UNION ALL
  SELECT a.bar_idx, a.rr, a.name || ' && ' || b.name, 2 FROM m a JOIN m b ON a.bar_idx = b.bar_idx AND a.idx < b.idx),
e AS (SELECT *, sum(rr) OVER w AS eq FROM t WINDOW w AS (PARTITION BY combination ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(eq) OVER w) - eq AS dd FROM e WINDOW w AS (PARTITION BY combination ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
g AS (SELECT combination, depth, count(*) AS total_bars, count(*) FILTER (rr > 0) AS profitable_bars, round(100.0 * count(*) FILTER (rr > 0) / count(*), 6) AS win_rate,
  sum(rr) AS total_return, max(dd) AS max_drawdown FROM p GROUP BY 1, 2)
SELECT * FROM g ORDER BY total_return DESC, combination LIMIT 10""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best AND-combinations of one or two candle flags over hourly bars, by total return."""
    df = T.next_bar(FE.builtin_features(S.bars_from_events(events(spark, sf))))
    names = FLAGS[:4]
    m = df.where("next_bar_up_eligible").select("symbol", "bar_idx", F.col("rr_next_bar_up").alias("rr"), F.col("next_bar_up").alias("label"),
                                                F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("m")).where("m.v")
    # the flags of a bar meet inside its row group: pairs are made from one array, without a join
    per = m.groupBy("symbol", "bar_idx", "rr", "label").agg(F.array_sort(F.collect_list(F.struct("m.idx", "m.name"))).alias("on"))
    combos = F.flatten(F.transform("on", lambda a: F.concat(
        F.array(F.struct(a["name"].alias("combination"), F.lit(1).alias("depth"))),
        F.transform(F.filter("on", lambda b: b["idx"] > a["idx"]), lambda b: F.struct(F.concat(a["name"], F.lit(" && "), b["name"]).alias("combination"), F.lit(2).alias("depth"))),
    )))
    t = per.select("symbol", "bar_idx", "rr", "label", F.explode(combos).alias("c")).select("symbol", "bar_idx", "rr", "label", "c.*")
    stats = M.core_stats(t).join(t.select("combination", "depth").distinct(), "combination")
    top = stats.orderBy(F.desc("total_return"), "combination").limit(10)
    return r6(top.select("combination", F.col("depth").cast("int"), "total_bars", "profitable_bars", "win_rate", "total_return", "max_drawdown"), "win_rate")


@query("bars_hourly", "WITH " + _bars("'ALL'") + " SELECT bar_idx, epoch(bts)::BIGINT AS t, open, high, low, close, volume FROM bars")
def bars_hourly(spark, sf):
    return S.bars_from_events(events(spark, sf)).select("bar_idx", F.unix_timestamp("ts").alias("t"), *S.PRICES)


@query("bars_by_type", BARS + " SELECT symbol, bar_idx, epoch(bts)::BIGINT AS t, open, high, low, close, volume FROM bars")
def bars_by_type(spark, sf):
    return by_type(spark, sf).select("symbol", "bar_idx", F.unix_timestamp("ts").alias("t"), *S.PRICES)


@query("date_range", BARS + " SELECT symbol, bar_idx, close FROM bars WHERE CAST(bts AS DATE) BETWEEN (SELECT min(CAST(bts AS DATE)) + 3 FROM bars) AND (SELECT min(CAST(bts AS DATE)) + 9 FROM bars)")
def date_range(spark, sf):
    b = materialize(by_type(spark, sf), "bars")
    d = b.agg(F.to_date(F.min("ts")).alias("d")).select(F.date_add("d", 3).cast("string"), F.date_add("d", 9).cast("string")).first()
    return S.date_filter(b, d[0], d[1]).select("symbol", "bar_idx", "close")


@query("candle_flags", BARS + FEATS + " SELECT symbol, bar_idx, is_green, is_red, is_inside_bar, is_range_expansion, round(high - low, 6) AS range, round(abs(close - open), 6) AS abs_body, busy, wide FROM feats")
def candle_flags(spark, sf):
    return r6(prepared(spark, sf).select("symbol", "bar_idx", "is_green", "is_red", "is_inside_bar", "is_range_expansion", "range", "abs_body", "busy", "wide"), "range", "abs_body")


@query("rolling_means_bands", BARS + """ SELECT symbol, bar_idx, round(CASE WHEN n9 = 9 THEN avg(close) OVER (w ROWS 8 PRECEDING) END, 6) AS sma_9,
  round(CASE WHEN n20 = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END, 6) AS mid, round(CASE WHEN n20 = 20 THEN stddev_samp(close) OVER (w ROWS 19 PRECEDING) END, 6) AS std,
  CASE WHEN n20 = 20 THEN min(low) OVER (w ROWS 19 PRECEDING) END AS low20,
  round(CASE WHEN n20 = 20 THEN stddev_samp(close) OVER (w ROWS 19 PRECEDING) / avg(close) OVER (w ROWS 19 PRECEDING) END, 6) AS cv
  FROM (SELECT *, count(*) OVER (w ROWS 8 PRECEDING) AS n9, count(*) OVER (w ROWS 19 PRECEDING) AS n20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)""")
def rolling_means_bands(spark, sf):
    c = C.num("close")
    _, mid, _ = FE.bollinger(c)
    df = by_type(spark, sf).withColumns({"sma_9": C.sma(c, 9), "mid": mid, "std": C.rolling_std(c, 20), "low20": C.rolling_min(C.num("low"), 20), "cv": C.rolling_cv(c, 20)})
    return r6(df.select("symbol", "bar_idx", "sma_9", "mid", "std", "low20", "cv"), "sma_9", "mid", "std", "cv")


@query("stochastic", BARS + """,
r AS (SELECT *, CASE WHEN n >= 14 THEN hi END - CASE WHEN n >= 14 THEN lo END AS rng FROM (SELECT *, row_number() OVER w AS n, max(high) OVER (w ROWS 13 PRECEDING) AS hi, min(low) OVER (w ROWS 13 PRECEDING) AS lo
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))),
k AS (SELECT *, CASE WHEN n >= 14 THEN greatest(0, least(100, (close - lo) / (rng + CASE WHEN bool_or(coalesce(rng = 0, false)) OVER (PARTITION BY symbol) THEN 1e-9 ELSE 0 END) * 100)) END AS raw FROM r),
s AS (SELECT *, CASE WHEN count(raw) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(raw) OVER (w ROWS 2 PRECEDING) END AS kk FROM k WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))
SELECT symbol, bar_idx, round(kk, 6) AS stoch_k, round(CASE WHEN count(kk) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(kk) OVER (w ROWS 2 PRECEDING) END, 6) AS stoch_d FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)""")
def stochastic(spark, sf):
    return r6(FE.with_stochastic(by_type(spark, sf)).select("symbol", "bar_idx", "stoch_k", "stoch_d"), "stoch_k", "stoch_d")


@query("roc_momentum", BARS + """ SELECT symbol, bar_idx, round(CASE WHEN bar_idx < 14 THEN 0 ELSE close - lag(close, 14) OVER w END, 6) AS momentum_14,
  round(CASE WHEN abs(lag(close, 5) OVER w) >= 2.220446049250313e-16 THEN close / lag(close, 5) OVER w - 1 END, 6) AS roc_5,
  round(coalesce(high - CASE WHEN bar_idx >= 19 THEN min(low) OVER (w ROWS 19 PRECEDING) END, 0), 6) AS ext, coalesce(close > lag(close) OVER w AND lag(close) OVER w > lag(close, 2) OVER w, false) AS rising2,
  coalesce(sum((close > open)::INT) OVER (w ROWS 2 PRECEDING) = 3 AND bar_idx >= 2, false) AS green3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)""")
def roc_momentum(spark, sf):
    c = C.num("close")
    df = by_type(spark, sf).withColumns({"momentum_14": C.momentum(c, 14), "roc_5": C.roc(c, 5), "ext": F.coalesce(C.num("high") - C.rolling_min(C.num("low"), 20), F.lit(0.0)), "rising2": C.double_rising(c), "green3": C.streak(c > F.col("open"), 3)})
    return r6(df.select("symbol", "bar_idx", "momentum_14", "roc_5", "ext", "rising2", "green3"), "momentum_14", "roc_5", "ext")


@query("percentile_rank", BARS + """ SELECT symbol, bar_idx, round((rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol), 6) AS pr FROM bars""")
def percentile_rank(spark, sf):
    return r6(O.with_average_ranks(by_type(spark, sf), {"pr": C.num("close")}).select("symbol", "bar_idx", "pr"), "pr")


@query("crosses", BARS + FEATS + """ SELECT symbol, bar_idx, coalesce(lag(close) OVER w <= lag(sma_9) OVER w AND close > sma_9, false) AS up, coalesce(lag(close) OVER w >= lag(sma_9) OVER w AND close < sma_9, false) AS down,
  coalesce(lag(close) OVER w < 50 AND close > 50, false) AS recovery FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)""")
def crosses(spark, sf):
    c, s = C.num("close"), F.col("sma_9")
    return prepared(spark, sf).select("symbol", "bar_idx", C.cross_up(c, s).alias("up"), C.cross_down(c, s).alias("down"), C.recovery(c, 50, True).alias("recovery"))


@query("week_month_index", BARS + """ SELECT symbol, week, month, count(*) AS bars, max(bar_idx) AS last_bar FROM (SELECT *, greatest(0, floor((epoch(bts) - 338400) / 604800))::BIGINT AS week, (year(bts) * 12 + month(bts) - 1)::BIGINT AS month FROM bars) GROUP BY ALL""")
def week_month_index(spark, sf):
    df = by_type(spark, sf).withColumns({"week": T.period_index(F.col("ts"), "weekly"), "month": T.period_index(F.col("ts"), "monthly")})
    return df.groupBy("symbol", "week", "month").agg(F.count(F.lit(1)).alias("bars"), F.max("bar_idx").alias("last_bar"))


@query("quantile_nearest", BARS + FEATS + """, l AS (SELECT unnest(['volume', 'range', 'abs_body']) AS name, unnest([volume, high - low, abs(close - open)]) AS v FROM feats),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM l)
SELECT name, q, round(v, 6) AS value FROM r, (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) t(q) WHERE i = round((n - 1) * q)""")
def quantile_nearest(spark, sf):
    df = materialize(prepared(spark, sf).select("volume", "range", "abs_body"), "bars")
    got = K.nearest_quantiles(df, df.columns, [0.5, 0.75])
    return r6(spark.createDataFrame([(c, q, v) for (c, q), v in got.items()], "name string, q double, value double"), "value")


@query("quantile_linear", BARS + """ SELECT symbol, round(quantile_cont(close, 0.01), 6) AS q01, round(quantile_cont(close, 0.8), 6) AS q80, round(quantile_cont(close, 0.99), 6) AS q99 FROM bars GROUP BY 1""")
def quantile_linear(spark, sf):
    qs = {"q01": 0.01, "q80": 0.8, "q99": 0.99}
    df = O.with_average_ranks(by_type(spark, sf), {}, {n: (C.num("close"), q) for n, q in qs.items()})
    return r6(df.select("symbol", *qs).distinct(), *qs)


@query("predicate_support", BARS + FEATS + """ SELECT count(*) FILTER (close > 100) AS close_gt, count(*) FILTER (volume <= 10) AS volume_le, count(*) FILTER (sma_9 >= sma_20) AS pair, count(*) FILTER (is_green AND close > 50 AND volume > 5) AS entry,
  count(*) FILTER (is_green AND elig AND rr IS NOT NULL) AS green_trades FROM feats""")
def predicate_support(spark, sf):
    df = prepared(spark, sf)
    n = lambda c: F.count_if(c)
    return df.agg(
        n(C.compare(F.col("close"), ">", 100)).alias("close_gt"), n(C.compare(F.col("volume"), "<=", 10)).alias("volume_le"), n(C.compare(F.col("sma_9"), ">=", F.col("sma_20"))).alias("pair"),
        n(C.parse_entry("is_green && close > 50 && volume > 5", df.columns)).alias("entry"), n(F.col("is_green") & F.col("next_bar_up_eligible") & F.col("rr_next_bar_up").isNotNull()).alias("green_trades"),
    )


@query("mask_dedupe", BARS + FEATS + """, m AS (SELECT unnest(['is_green','twin','never','wide']) AS name, unnest([0,1,2,3]) AS idx, unnest([is_green, close > open, false, wide]) AS v, symbol, bar_idx FROM feats),
d AS (SELECT name, idx, string_agg(symbol || bar_idx, ',' ORDER BY symbol, bar_idx) FILTER (v) AS rows, count(*) FILTER (v) AS support, count(*) AS n FROM m GROUP BY ALL)
SELECT name, support FROM (SELECT *, row_number() OVER (PARTITION BY rows ORDER BY idx) AS k FROM d WHERE support > 0 AND support < n) WHERE k = 1""")
def mask_dedupe(spark, sf):
    df = prepared(spark, sf).withColumns({"twin": C.true(F.col("close") > F.col("open")), "never": F.lit(False)})
    df = materialize(df.select("symbol", "bar_idx", "is_green", "twin", "never", "wide"), "masks")
    names = X.first_of_equal_masks(df, ["is_green", "twin", "never", "wide"])
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("m")).groupBy("m.name").agg(F.count_if("m.v").alias("support"))


#: The kinds of an event (its type and part of the day), as a catalog in order.
_KINDS = """k AS (SELECT DISTINCT event_type || '/' || (hour(ts) // 12) AS kind FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL), c AS (SELECT row_number() OVER (ORDER BY kind) - 1 AS i, kind FROM k)"""


def kinds(spark, sf) -> list[str]:
    kind = F.concat_ws("/", "event_type", F.floor(F.hour("ts") / 12).cast("string"))
    return sorted(r[0] for r in events(spark, sf).where("event_type is not null and ts is not null").select(kind.alias("kind")).distinct().collect())


@query("combo_enumerate_d3", "WITH " + _KINDS + """, t AS (
  SELECT 1 AS depth, lpad(i::VARCHAR, 2, '0') AS k, kind AS names FROM c UNION ALL SELECT 2, lpad(a.i::VARCHAR, 2, '0') || '-' || lpad(b.i::VARCHAR, 2, '0'), a.kind || ' && ' || b.kind FROM c a JOIN c b ON a.i < b.i UNION ALL
  SELECT 3, lpad(a.i::VARCHAR, 2, '0') || '-' || lpad(b.i::VARCHAR, 2, '0') || '-' || lpad(d.i::VARCHAR, 2, '0'), a.kind || ' && ' || b.kind || ' && ' || d.kind FROM c a JOIN c b ON a.i < b.i JOIN c d ON b.i < d.i)
SELECT row_number() OVER (ORDER BY depth, k) - 1 AS combo_id, depth, names AS combo FROM t""")
def combo_enumerate_d3(spark, sf):
    """Combinations of up to three kinds of events by their ranks."""
    names = kinds(spark, sf)
    e = X.enumerate_range(spark, len(names), 3)
    named = F.transform("combo", lambda x: F.get(F.array(*map(F.lit, names)), x))
    return e.select("combo_id", F.size("combo").alias("depth"), F.array_join(named, " && ").alias("combo"))


@query("combo_join_d2", "WITH " + _KINDS + " SELECT kind AS combo FROM c UNION ALL SELECT a.kind || ' && ' || b.kind FROM c a JOIN c b ON a.i < b.i")
def combo_join_d2(spark, sf):
    """Combinations of up to two kinds of events by ordered self-joins."""
    cat = K.catalog_frame(spark, [K.flag(n) for n in kinds(spark, sf)])
    named = X.enumerate_join(cat, 2).select(F.col("combo").alias("n"), F.posexplode("combo")).join(cat.select(F.col("idx").alias("col"), "name"), "col")
    return named.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " && ").alias("combo")).select("combo")


@query("combo_support_bits", BARS + FEATS + f""", m AS (SELECT symbol, bar_idx, unnest(range(0, 8))::INTEGER AS i, unnest([{", ".join(FLAGS)}]) AS v FROM feats)
SELECT a.i AS a, b.i AS b, count(*) AS support FROM m a JOIN m b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx AND a.i < b.i AND a.v AND b.v GROUP BY 1, 2""")
def combo_support_bits(spark, sf):
    return X.pair_support(X.mask_words(prepared(spark, sf), FLAGS))


_BOUNDED = BARS + FEATS + """, s AS (SELECT quantile_cont(volume, [0.25, 0.5, 0.75]) AS v, quantile_cont(high - low, [0.25, 0.5, 0.75]) AS r FROM bars),
m AS (SELECT symbol, bar_idx, unnest(range(0, 6)) AS i, unnest([volume > s.v[1], volume > s.v[2], volume < s.v[3], high - low > s.r[1], high - low < s.r[3], is_green]) AS f FROM feats, s WHERE elig),
n AS (SELECT i, CASE WHEN i IN (0, 1) THEN 'volume>' WHEN i = 2 THEN 'volume<' WHEN i = 3 THEN 'range>' WHEN i = 4 THEN 'range<' ELSE 'green' END AS kind FROM range(0, 6) t(i))"""


def bounded(spark, sf) -> tuple[DataFrame, list[X.Predicate]]:
    """Bars with six predicates: volume over its first quartile and its median, under its third; range over and under; green."""
    df = materialize(prepared(spark, sf), "bars")
    q = O.linear_quantiles(df, ["volume", "range"], [0.25, 0.5, 0.75])
    v, r = q["volume"], q["range"]
    preds = [("volume", ">", v[0]), ("volume", ">", v[1]), ("volume", "<", v[2]), ("range", ">", r[0]), ("range", "<", r[2])]
    df = df.withColumns({f"p{i}": C.compare(F.col(c), op, x) for i, (c, op, x) in enumerate(preds)} | {"p5": F.col("is_green")})
    return df, [X.Predicate(f"p{i}", c, op) for i, (c, op, _) in enumerate(preds)] + [X.Predicate("p5")]


@query("scalar_bound_prune", _BOUNDED + """ SELECT a.symbol, 'p' || a.i || ' && p' || b.i AS combination, count(*) AS total_bars
FROM m a JOIN m b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx AND a.i < b.i AND a.f AND b.f JOIN n x ON x.i = a.i JOIN n y ON y.i = b.i WHERE x.kind <> y.kind GROUP BY ALL""")
def scalar_bound_prune(spark, sf):
    """Pairs of predicates with at most one lower and one upper bound of a column, with their trades."""
    df, preds = bounded(spark, sf)
    out = Q.search(Q.pack(df, [p.name for p in preds], "next_bar_up"), preds, 2)
    return out.where("depth = 2").select("symbol", "combination", "total_bars")


@query("dead_pair_prune", _BOUNDED + """, d AS (SELECT i, j, coalesce(max(c), 0) AS c FROM (SELECT x.i, y.i AS j FROM n x JOIN n y ON x.i < y.i) LEFT JOIN
    (SELECT symbol, a.i, b.i AS j, count(*) AS c FROM m a JOIN m b USING (symbol, bar_idx) WHERE a.i < b.i AND a.f AND b.f GROUP BY ALL) USING (i, j) GROUP BY ALL)
SELECT i, j FROM d WHERE c < 300""")
def dead_pair_prune(spark, sf):
    """Pairs of predicates with fewer than 300 common trades in every symbol: no deeper combination of them can have more."""
    df, preds = bounded(spark, sf)
    rows = Q.dead_pairs(Q.pack(df, [p.name for p in preds], "next_bar_up"), 300)
    bit = lambda k: F.conv(F.hex(F.substring("bits", 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(128 >> k)) > 0
    later = F.array_compact(F.array(*[F.when(bit(k), F.col("i") + 1 + k) for k in range(len(preds) - 1)]))
    return rows.where(F.length("bits") > 0).select("i", F.explode(later).alias("j"))


@query("core_stats", BARS + CURVES + """ SELECT combination, symbol, count(*) AS total_bars, count(*) FILTER (rr > 0) AS profitable_bars, count(*) FILTER (rr < 0) AS unprofitable_bars, count(*) FILTER (label) AS label_hits,
  round(100.0 * count(*) FILTER (rr > 0) / count(*), 6) AS win_rate, sum(rr) AS total_return, round(avg(rr), 6) AS expectancy, max(drawdown) AS max_drawdown FROM curves GROUP BY 1, 2""")
def core_stats(spark, sf):
    return r6(M.core_stats(flag_trades(spark, sf)).drop("label_hit_rate"), "win_rate", "expectancy")


@query("drawdown_curve", BARS + CURVES + " SELECT combination, symbol, bar_idx, equity, peak, drawdown FROM curves")
def drawdown_curve(spark, sf):
    return M.with_curves(flag_trades(spark, sf)).select("combination", "symbol", "bar_idx", "equity", "peak", "drawdown")


@query("streaks", BARS + CURVES + """, s AS (SELECT combination, symbol, streak, sgn, count(*) AS len FROM curves GROUP BY ALL)
SELECT combination, symbol, coalesce(max(len) FILTER (sgn > 0), 0) AS max_win_streak, coalesce(max(len) FILTER (sgn < 0), 0) AS max_loss_streak, round(coalesce(avg(len) FILTER (sgn > 0), 0), 6) AS avg_win_streak FROM s GROUP BY 1, 2""")
def streaks(spark, sf):
    return r6(M.full_stats(flag_trades(spark, sf)).select("combination", "symbol", "max_win_streak", "max_loss_streak", F.col("avg_win_streak").cast("double")), "avg_win_streak")


_RICH = BARS + """, t AS (SELECT symbol, bar_idx, close - lag(close) OVER w AS rr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)), u AS (SELECT * FROM t WHERE rr IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rr) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM u)"""


def move_trades(spark, sf):
    df = by_type(spark, sf).withColumn("rr", C.num("close") - C.lag(C.num("close"))).where("rr is not null")
    return df.select(F.lit("all").alias("combination"), "symbol", "bar_idx", "rr", F.lit(True).alias("label"), F.lit(None).cast("long").alias("exit_i"))


@query("tail_percentiles", _RICH + """ SELECT symbol, round(median(rr), 6) AS median_rr, round(max(rr) FILTER (i = round((n - 1) * 0.05::DOUBLE)), 6) AS p05_rr, round(max(rr) FILTER (i = round((n - 1) * 0.95::DOUBLE)), 6) AS p95_rr,
  round(max(rr) FILTER (rr > 0), 6) AS largest_win, round(max(-rr) FILTER (rr < 0), 6) AS largest_loss FROM r GROUP BY 1""")
def tail_percentiles(spark, sf):
    names = ("median_rr", "p05_rr", "p95_rr", "largest_win", "largest_loss")
    return r6(M.full_stats(move_trades(spark, sf)).select("symbol", *names), *names)


@query("risk_ratios", _RICH + """ SELECT symbol, round(sum(rr) FILTER (rr > 0) / -sum(rr) FILTER (rr < 0), 6) AS profit_factor, round(avg(rr) / stddev_pop(rr) * sqrt(count(*) / 2.0), 6) AS sharpe,
  round(avg(rr) / sqrt(avg(rr * rr) FILTER (rr < 0)) * sqrt(count(*) / 2.0), 6) AS sortino, round(avg(rr) FILTER (rr > 0), 6) AS avg_win FROM r GROUP BY 1""")
def risk_ratios(spark, sf):
    names = ("profit_factor", "sharpe", "sortino", "avg_win")
    return r6(M.full_stats(move_trades(spark, sf), years=2.0).select("symbol", *names), *names)


@query("label_only_stats", BARS + FEATS + f""", m AS (SELECT label, unnest({_MASKS}) AS combination FROM feats), g AS (SELECT combination, count(*) AS total_bars, count(*) FILTER (label) AS profitable_bars FROM m WHERE combination IS NOT NULL GROUP BY 1)
SELECT *, round(100.0 * profitable_bars / total_bars, 6) AS win_rate, round(2.0 * profitable_bars / total_bars - 1, 6) AS expectancy FROM g""")
def label_only_stats(spark, sf):
    out = M.label_stats(prepared(spark, sf), {n: F.col(n) for n in FLAGS}, "next_bar_up")
    return r6(out.drop("profit_factor"), "win_rate", "expectancy")


@query("next_bar_targets", BARS + FEATS + " SELECT symbol, bar_idx, label AS up, elig, rr, CASE WHEN elig THEN bar_idx + 1 ELSE -1 END AS exit_i FROM feats")
def next_bar_targets(spark, sf):
    return prepared(spark, sf).select("symbol", "bar_idx", F.col("next_bar_up").alias("up"), F.col("next_bar_up_eligible").alias("elig"), F.col("rr_next_bar_up").alias("rr"), F.col("next_bar_up_exit_i").alias("exit_i"))


@query("highlow_1r", BARS + """, s AS (SELECT symbol, bar_idx AS entry_idx, CASE WHEN close > open THEN 1 ELSE -1 END AS side, close AS entry, CASE WHEN close > open THEN low ELSE high END AS stop FROM bars WHERE abs(close - open) > 2.220446049250313e-16),
l AS (SELECT *, (entry - stop) * side AS risk, entry + side * ((entry - stop) * side) AS tp FROM s WHERE (entry - stop) * side > 1e-9),
j AS (SELECT l.*, b.bar_idx AS j, CASE WHEN (b.open - stop) * side <= 0 THEN [(b.open - entry) * side / risk, 0.0] WHEN (b.open - tp) * side >= 0 THEN [(b.open - entry) * side / risk, 1.0]
  WHEN (CASE WHEN side = 1 THEN b.low ELSE b.high END - stop) * side <= 0 THEN [-1.0, 0.0] WHEN (CASE WHEN side = 1 THEN b.high ELSE b.low END - tp) * side >= 0 THEN [(tp - entry) * side / risk, 1.0] END AS t
  FROM l JOIN bars b ON b.symbol = l.symbol AND b.bar_idx > l.entry_idx)
SELECT symbol, entry_idx, side, round(arg_min(t, j)[1], 6) AS rr, arg_min(t, j)[2] = 1 AS hit, min(j) AS exit_idx FROM j WHERE t IS NOT NULL GROUP BY ALL""")
def highlow_1r(spark, sf):
    b = materialize(by_type(spark, sf).withColumn("atr", F.lit(None).cast("double")), "bars")
    return r6(T.resolve(T.levels(b, T.BRACKETS["highlow_1r"]), b), "rr")


@query("ema_rma_kalman", RBARS + """,
tr AS (SELECT symbol, bar_idx, close, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
  avg(close) OVER (w ROWS 8 PRECEDING) AS m9 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
rec AS (SELECT symbol, bar_idx, NULL::DOUBLE AS ema9, tr AS atr, close AS kf, (1.01 * 0.1 / 1.11)::DOUBLE AS p FROM tr WHERE bar_idx = 0
  UNION ALL SELECT t.symbol, t.bar_idx, CASE WHEN t.bar_idx = 8 THEN t.m9 WHEN t.bar_idx > 8 THEN 0.2 * t.close + 0.8 * r.ema9 END, t.tr / 14.0 + (13.0 / 14.0) * r.atr,
    r.kf + (r.p + 0.01) / (r.p + 0.11) * (t.close - r.kf), (1 - (r.p + 0.01) / (r.p + 0.11)) * (r.p + 0.01)
  FROM rec r JOIN tr t ON t.symbol = r.symbol AND t.bar_idx = r.bar_idx + 1)
SELECT symbol, bar_idx, round(ema9, 6) AS ema9, round(atr, 6) AS atr, round(kf, 6) AS kf_smooth FROM rec""")
def ema_rma_kalman(spark, sf):
    return r6(with_recursive(by_type(spark, sf)).select("symbol", "bar_idx", "ema9", "atr", "kf_smooth"), "ema9", "atr", "kf_smooth")


_FILTERED = ("smooth", 0.01, 0.1), ("trend", 0.001, 0.5), ("wicks", 0.01, 0.1)
_EMA = lambda p: f"CASE WHEN t.bar_idx = {p - 1} THEN t.m{p} WHEN t.bar_idx > {p - 1} THEN 2.0::DOUBLE / {p + 1} * t.close + (1 - 2.0::DOUBLE / {p + 1}) * r.ema{p} END AS ema{p}"
_RMA = lambda x, p=14: f"t.{x} / {p}.0::DOUBLE + ({p - 1}.0::DOUBLE / {p}) * r.s_{x} AS s_{x}"
_KF = lambda k, y, q, v: f"r.kf_{k} + (r.p_{k} + {q}) / (r.p_{k} + {q} + {v}) * ({y} - r.kf_{k}) AS kf_{k}, {v} / (r.p_{k} + {q} + {v}) * (r.p_{k} + {q}) AS p_{k}, {y} - r.kf_{k} AS i_{k}"
_KF0 = lambda k, y, q, v: f"{y} AS kf_{k}, ({v} / (1 + {q} + {v}) * (1 + {q}))::DOUBLE AS p_{k}, 0.0::DOUBLE AS i_{k}"
_RECURRENCES = RBARS + f""",
b0 AS (SELECT *, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, CASE WHEN close > open THEN open - low ELSE high - open END AS wick FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
tr AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus,
  greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, abs(close - pc) AS move FROM b0),
t AS (SELECT *, CASE WHEN bar_idx = 0 THEN 0 ELSE tr END AS zr, avg(move) OVER (w ROWS 13 PRECEDING) AS mm, {", ".join(f"avg(close) OVER (w ROWS {p - 1} PRECEDING) AS m{p}" for p in (12, 26, 50))} FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
r1 AS (SELECT symbol, bar_idx, NULL::DOUBLE AS ema12, NULL::DOUBLE AS ema26, NULL::DOUBLE AS ema50, tr AS s_tr, 0.0::DOUBLE AS s_zr, 0.0::DOUBLE AS s_plus, 0.0::DOUBLE AS s_minus, NULL::DOUBLE AS s_gain, NULL::DOUBLE AS s_loss, NULL::DOUBLE AS c2c,
    {", ".join(_KF0(k, "wick" if k == "wicks" else "close", q, v) for k, q, v in _FILTERED)} FROM t WHERE bar_idx = 0
  UNION ALL SELECT t.symbol, t.bar_idx, {", ".join(_EMA(p) for p in (12, 26, 50))}, {", ".join(_RMA(x) for x in ("tr", "zr", "plus", "minus"))},
    {", ".join(f"CASE WHEN t.bar_idx = 1 THEN t.{x} ELSE t.{x} / 14.0::DOUBLE + (13.0::DOUBLE / 14) * r.s_{x} END AS s_{x}" for x in ("gain", "loss"))},
    CASE WHEN t.bar_idx < 14 THEN t.mm ELSE 2.0::DOUBLE / 15 * t.move + (1 - 2.0::DOUBLE / 15) * r.c2c END AS c2c, {", ".join(_KF(k, "t.wick" if k == "wicks" else "t.close", q, v) for k, q, v in _FILTERED)}
  FROM r1 r JOIN t ON t.symbol = r.symbol AND t.bar_idx = r.bar_idx + 1),
d0 AS (SELECT *, CASE WHEN s_zr > 2.3e-16 THEN 100 * s_plus / s_zr ELSE 0 END AS pdi, CASE WHEN s_zr > 2.3e-16 THEN 100 * s_minus / s_zr ELSE 0 END AS mdi, ema12 - ema26 AS line, lead(c2c) OVER (PARTITION BY symbol ORDER BY bar_idx) AS nc2c FROM r1),
d AS (SELECT *, CASE WHEN pdi + mdi > 2.3e-16 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx, avg(line) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 8 PRECEDING) AS m9 FROM d0),
r2 AS (SELECT symbol, bar_idx, dx AS s_dx, NULL::DOUBLE AS signal, {_KF0("atr", "s_tr", 0.01, 0.15)}, nc2c AS kf_c2c, 1.01::DOUBLE AS p_c2c, 0.0::DOUBLE AS i_c2c FROM d WHERE bar_idx = 0
  UNION ALL SELECT t.symbol, t.bar_idx, {_RMA("dx")}, CASE WHEN t.bar_idx = 33 THEN t.m9 WHEN t.bar_idx > 33 THEN 0.2::DOUBLE * t.line + 0.8::DOUBLE * r.signal END, {_KF("atr", "t.s_tr", 0.01, 0.15)}, {_KF("c2c", "t.c2c", 0.01, 0.15)}
  FROM r2 r JOIN d t ON t.symbol = r.symbol AND t.bar_idx = r.bar_idx + 1),
r3 AS (SELECT symbol, bar_idx, {_KF0("adx", "s_dx", 0.005, 0.2)} FROM r2 WHERE bar_idx = 0
  UNION ALL SELECT t.symbol, t.bar_idx, {_KF("adx", "t.s_dx", 0.005, 0.2)} FROM r3 r JOIN r2 t ON t.symbol = r.symbol AND t.bar_idx = r.bar_idx + 1)
SELECT symbol, bar_idx, round(ema50, 6) AS ema50, round(CASE WHEN s_loss = 0 THEN 100 ELSE 100 - 100 / (1 + s_gain / s_loss) END, 6) AS rsi_14, round(line, 6) AS macd, round(signal, 6) AS macd_signal, round(s_dx, 6) AS adx,
  round(c2c, 6) AS atr_c2c, round(kf_trend, 6) AS kf_trend, round(i_smooth, 6) AS kf_innovation, round(kf_wicks, 6) AS kf_wicks_smooth, round(kf_atr, 6) AS kf_atr, round(i_atr, 6) AS kf_atr_innovation, round(kf_c2c, 6) AS kf_atr_c2c,
  round(i_c2c, 6) AS kf_atr_c2c_innovation, round(kf_adx, 6) AS kf_adx, round(i_adx, 6) AS kf_adx_innovation FROM d JOIN r2 USING (symbol, bar_idx) JOIN r3 USING (symbol, bar_idx)"""
_RECURSIVE = ("ema50 rsi_14 macd macd_signal adx atr_c2c kf_trend kf_innovation kf_wicks_smooth kf_atr kf_atr_innovation kf_atr_c2c kf_atr_c2c_innovation kf_adx kf_adx_innovation").split()


@query("recursive_indicators", _RECURRENCES)
def recursive_indicators(spark, sf):
    return r6(with_recursive(by_type(spark, sf)).select("symbol", "bar_idx", *_RECURSIVE), *_RECURSIVE)


@query("recurrences_by_scan", _RECURRENCES)
def recurrences_by_scan(spark, sf):
    """The same columns by the scan over blocks, of 256 bars here."""
    out = with_recursive_blocks(by_type(spark, sf), 256).withColumns({c: C.num(c) for c in _RECURSIVE})
    return r6(out.select("symbol", "bar_idx", *_RECURSIVE), *_RECURSIVE)


@query("fractional_equity", BARS + CURVES + """, q AS (SELECT *, 100000.0 * exp(sum(ln(1 + rr * 0.01)) OVER (PARTITION BY combination, symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)) AS cap FROM trades),
p AS (SELECT *, greatest(100000.0, max(cap) OVER (PARTITION BY combination, symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)) AS pk FROM q)
SELECT combination, symbol, round(arg_max(cap, bar_idx) / 100000 - 1, 6) AS growth, round(max((pk - cap) / pk * 100), 6) AS equity_max_dd_pct FROM p GROUP BY 1, 2""")
def fractional_equity(spark, sf):
    e = M.equity(flag_trades(spark, sf), M.Sizing())
    return e.select("combination", "symbol", F.round(F.col("total_return_pct") / 100, 6).alias("growth"), F.round("equity_max_dd_pct", 6).alias("equity_max_dd_pct"))


@query("contracts_equity", RBARS + FEATS + f""",
trades AS MATERIALIZED (SELECT symbol, rr, combination, row_number() OVER (PARTITION BY combination, symbol ORDER BY bar_idx) AS i FROM (SELECT *, unnest({_MASKS}) AS combination FROM feats) WHERE combination IS NOT NULL AND elig),
rec AS (SELECT DISTINCT combination, symbol, 0::BIGINT AS i, 100000.0::DOUBLE AS cap, 100000.0::DOUBLE AS pk, 0.0::DOUBLE AS dd, 0.0::DOUBLE AS pct FROM trades
  UNION ALL SELECT combination, symbol, i, cap, greatest(pk, cap), greatest(dd, greatest(pk, cap) - cap), greatest(pct, 100 * (greatest(pk, cap) - cap) / greatest(pk, cap)) FROM (
    SELECT r.combination, r.symbol, t.i, r.pk, r.dd, r.pct, r.cap + least(20.0, greatest(1.0, floor(r.cap * 0.01 / 250)), greatest(0.0, floor(r.cap / 2500))) * 250 * t.rr AS cap
    FROM rec r JOIN trades t ON t.combination = r.combination AND t.symbol = r.symbol AND t.i = r.i + 1))
SELECT combination, symbol, round(arg_max(cap, i), 6) AS final_capital, round(max(pct), 6) AS equity_max_dd_pct, round(max(dd), 6) AS equity_max_dd, round(100 * (arg_max(cap, i) / 100000 - 1), 6) AS total_return_pct,
  round(CASE WHEN max(pct) > 0 THEN 100 * (arg_max(cap, i) / 100000 - 1) / max(pct) WHEN arg_max(cap, i) > 100000 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS calmar_ratio FROM rec GROUP BY 1, 2""")
def contracts_equity(spark, sf):
    t = flag_trades(spark, sf).withColumn("rpc", F.lit(250.0))
    out = M.equity(t, M.Sizing(mode="contracts", capital=100_000, risk_pct=1, max_contracts=20, margin=2500), "rpc")
    names = ("final_capital", "equity_max_dd_pct", "equity_max_dd", "total_return_pct", "calmar_ratio")
    return r6(out.select("combination", "symbol", *names), *names)


@query("no_stacking", RBARS + FEATS + """, h AS (SELECT symbol, bar_idx, CASE WHEN bar_idx % 3 = 0 THEN bar_idx + 4 ELSE bar_idx + 2 END AS x FROM feats WHERE is_green AND elig),
rec AS (SELECT symbol, min(bar_idx) AS bar_idx FROM h GROUP BY 1 UNION ALL SELECT r.symbol, (SELECT min(n.bar_idx) FROM h n WHERE n.symbol = r.symbol AND n.bar_idx >= h.x) FROM rec r JOIN h ON h.symbol = r.symbol AND h.bar_idx = r.bar_idx WHERE r.bar_idx IS NOT NULL)
SELECT symbol, count(*) AS trades, sum(bar_idx)::BIGINT AS sum_idx FROM rec WHERE bar_idx IS NOT NULL GROUP BY 1""")
def no_stacking(spark, sf):
    df = prepared(spark, sf).where(F.col("is_green") & F.col("next_bar_up_eligible"))
    t = df.select(F.lit("g").alias("combination"), "symbol", "bar_idx", F.col("rr_next_bar_up").alias("rr"), F.col("next_bar_up").alias("label"), F.when(F.col("bar_idx") % 3 == 0, F.col("bar_idx") + 4).otherwise(F.col("bar_idx") + 2).alias("exit_i"))
    return M.without_stacking(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("bar_idx").alias("sum_idx"))


_ORDERS = """o AS (SELECT 'h' AS csv_hash, 'long' AS direction, o_orderstatus AS target, o_orderpriority || ' && ' || (o_custkey % 7) AS combination, count(*) AS total_bars, count(*) FILTER (o_totalprice > 100000) AS profitable_bars, max(o_totalprice) / 1000 AS max_drawdown, avg(o_totalprice) AS calmar_ratio FROM orders GROUP BY ALL)"""


@query("top_results", "WITH " + _ORDERS + " SELECT target, combination, total_bars, round(calmar_ratio, 6) AS calmar_ratio FROM o WHERE total_bars >= 5 AND max_drawdown <= 480 ORDER BY o.calmar_ratio DESC, combination LIMIT 7")
def top_results(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderstatus").alias("target"), F.concat_ws(" && ", "o_orderpriority", (F.col("o_custkey") % 7).cast("string")).alias("combination")).agg(
        F.count(F.lit(1)).alias("total_bars"), (F.max("o_totalprice") / 1000).alias("max_drawdown"), F.avg("o_totalprice").alias("calmar_ratio"))
    return r6(ST.top_results(o, 7, 5, 480.0).select("target", "combination", "total_bars", "calmar_ratio"), "calmar_ratio")


@query("results_union_distinct", """SELECT DISTINCT c AS combination FROM (SELECT l_returnflag || ' && ' || l_linestatus AS c FROM lineitem UNION ALL SELECT o_orderstatus || ' && ' || o_orderpriority FROM orders)""")
def results_union_distinct(spark, sf):
    a = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat_ws(" && ", "l_returnflag", "l_linestatus").alias("combination"))
    b = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat_ws(" && ", "o_orderstatus", "o_orderpriority").alias("combination"))
    return a.unionByName(b).distinct()


def _names(i: str) -> str:
    return f"[{', '.join(repr(n) for n in FLAGS)}][{i}]"


@query("search_d2", "WITH " + _bars("'ALL'") + FEATS + f""", m AS (SELECT bar_idx, rr, unnest(range(1, 9)) AS i, unnest([{", ".join(FLAGS)}]) AS v FROM feats WHERE elig),
t AS (SELECT bar_idx, rr, {_names('i')} AS combination, 1 AS depth FROM m WHERE v UNION ALL SELECT a.bar_idx, a.rr, {_names('a.i')} || ' && ' || {_names('b.i')}, 2 FROM m a JOIN m b ON a.bar_idx = b.bar_idx AND a.i < b.i AND a.v AND b.v),
e AS (SELECT *, sum(rr) OVER w AS eq FROM t WINDOW w AS (PARTITION BY combination ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(eq) OVER w) - eq AS dd FROM e WINDOW w AS (PARTITION BY combination ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))
SELECT combination, depth, count(*) AS total_bars, count(*) FILTER (rr > 0) AS profitable_bars, sum(rr) AS total_return, max(dd) AS max_drawdown FROM p GROUP BY 1, 2 HAVING count(*) >= 5""")
def search_d2(spark, sf):
    df = T.next_bar(FE.builtin_features(S.bars_from_events(events(spark, sf)))).withColumns({
        "above_sma9": C.true(F.col("close") > F.col("sma_9")), "above_sma20": C.true(F.col("close") > F.col("sma_20")), "busy": C.true(F.col("volume") > C.lag(F.col("volume"))), "wide": C.true(F.col("abs_body") > 0.5 * F.col("range"))})
    out = Q.search(Q.pack(df, FLAGS, "next_bar_up"), [X.Predicate(n) for n in FLAGS], 2, min_sample=5)
    return out.select("combination", "depth", "total_bars", "profitable_bars", "total_return", "max_drawdown")


@query("search_symbols_d3", BARS + FEATS + f""", m AS (SELECT symbol, bar_idx, rr, label, unnest(range(1, 9)) AS i, unnest([{", ".join(FLAGS)}]) AS v FROM feats WHERE elig),
n AS (SELECT * FROM m WHERE v),
t AS (SELECT symbol, bar_idx, rr, label, {_names('i')} AS combination, 1 AS depth FROM n UNION ALL
  SELECT a.symbol, a.bar_idx, a.rr, a.label, {_names('a.i')} || ' && ' || {_names('b.i')}, 2 FROM n a JOIN n b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx AND a.i < b.i UNION ALL
  SELECT a.symbol, a.bar_idx, a.rr, a.label, {_names('a.i')} || ' && ' || {_names('b.i')} || ' && ' || {_names('c.i')}, 3
  FROM n a JOIN n b ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx AND a.i < b.i JOIN n c ON a.symbol = c.symbol AND a.bar_idx = c.bar_idx AND b.i < c.i),
e AS (SELECT *, sum(rr) OVER w AS eq, 100000.0 * exp(sum(ln(1 + rr * 0.01)) OVER w) AS cap FROM t WINDOW w AS (PARTITION BY symbol, combination ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(eq) OVER w) - eq AS dd, greatest(100000.0, max(cap) OVER w) AS pk FROM e WINDOW w AS (PARTITION BY symbol, combination ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
g AS (SELECT symbol, combination, depth, count(*) AS total_bars, count(*) FILTER (rr > 0) AS profitable_bars, count(*) FILTER (label) AS label_hits, sum(rr) AS total_return, max(dd) AS max_drawdown,
  100 * (arg_max(cap, bar_idx) / 100000 - 1) AS cagr, max((pk - cap) / pk * 100) AS pct FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 10)
SELECT symbol, combination, depth, total_bars, profitable_bars, label_hits, total_return, max_drawdown, round(CASE WHEN pct > 0 THEN cagr / pct WHEN cagr > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS calmar_ratio FROM g""")
def search_symbols_d3(spark, sf):
    """All combinations of up to three of eight flags over every symbol at once, with the capital's path."""
    out = Q.search(Q.pack(prepared(spark, sf), FLAGS, "next_bar_up"), [X.Predicate(n) for n in FLAGS], 3, min_sample=10, capital=X.Capital())
    return r6(out.select("symbol", "combination", "depth", "total_bars", "profitable_bars", "label_hits", "total_return", "max_drawdown", "calmar_ratio"), "calmar_ratio")


@query("rich_indicators")
def rich_indicators(spark, sf):
    return FE.rich_features(by_type(spark, sf))


_ATR = RBARS + """,
tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
rec AS (SELECT symbol, bar_idx, tr AS atr FROM tr WHERE bar_idx = 0
  UNION ALL SELECT t.symbol, t.bar_idx, t.tr / 14.0 + (13.0 / 14.0) * r.atr FROM rec r JOIN tr t ON t.symbol = r.symbol AND t.bar_idx = r.bar_idx + 1),
v AS (SELECT t.*, rec.atr, CASE WHEN close > open THEN 1 ELSE -1 END AS side, CASE WHEN close > open THEN low ELSE high END AS far,
  close - CASE WHEN close > open THEN 1 ELSE -1 END * atr AS near FROM tr t JOIN rec USING (symbol, bar_idx) WHERE abs(close - open) > 2.220446049250313e-16)"""
_STOPS = {
    "wide": "CASE WHEN side = 1 THEN least(far, near) ELSE greatest(far, near) END", "highlow": "far", "atr": "near",
    "tightest": "CASE WHEN (close - far) * side > 0 AND (close - near) * side > 0 THEN CASE WHEN side = 1 THEN greatest(far, near) ELSE least(far, near) END WHEN (close - far) * side > 0 THEN far ELSE near END",
}


def _bracket_sql(stop: str, reach: str, min_rr: bool = False, tick: float | None = None, end: str | None = None) -> str:
    """First touches by a join of every trade with every later bar; with ``end`` trades opened by that day are closed with it."""
    grid = (lambda x, way: f"CASE WHEN side = 1 THEN {way[0]}(({x}) / {tick}) ELSE {way[1]}(({x}) / {tick}) END * {tick}") if tick else (lambda x, way: x)
    sql = _ATR + f""",
s AS (SELECT symbol, bar_idx AS entry_idx, CAST(bts AS DATE) AS day, side, close AS entry, atr, {grid(_STOPS[stop], ("floor", "ceil"))} AS stop FROM v),
k AS (SELECT *, (entry - stop) * side AS risk FROM s WHERE (entry - stop) * side > 1e-9),
l AS (SELECT * FROM (SELECT *, {grid(f"entry + side * ({reach})", ("ceil", "floor"))} AS tp FROM k) {"WHERE (tp - entry) * side / risk > 1" if min_rr else ""}),
j AS (SELECT l.*, b.bar_idx AS j, CASE WHEN (b.open - stop) * side <= 0 THEN [(b.open - entry) * side / risk, 0.0] WHEN (b.open - tp) * side >= 0 THEN [(b.open - entry) * side / risk, 1.0]
  WHEN (CASE WHEN side = 1 THEN b.low ELSE b.high END - stop) * side <= 0 THEN [-1.0, 0.0] WHEN (CASE WHEN side = 1 THEN b.high ELSE b.low END - tp) * side >= 0 THEN [(tp - entry) * side / risk, 1.0] END AS t
  FROM l JOIN bars b ON b.symbol = l.symbol AND b.bar_idx > l.entry_idx),
f AS (SELECT symbol, entry_idx, side, arg_min(t, j)[1] AS rr, arg_min(t, j)[2] = 1 AS hit, min(j) AS exit_idx FROM j WHERE t IS NOT NULL GROUP BY ALL)"""
    if end is None:
        return sql + " SELECT symbol, entry_idx, side, round(rr, 6) AS rr, hit, exit_idx FROM f"
    return sql + f""",
c AS (SELECT symbol, max(bar_idx) AS cut, arg_max(close, bar_idx) AS price FROM bars WHERE CAST(bts AS DATE) <= DATE '{end}' GROUP BY 1),
e AS (SELECT l.symbol, l.entry_idx, l.side, l.entry_idx <= c.cut AND (f.exit_idx IS NULL OR f.exit_idx > c.cut) AS late, f.rr, f.hit, f.exit_idx, c.cut, (c.price - l.entry) * l.side / l.risk AS forced
  FROM l LEFT JOIN c USING (symbol) LEFT JOIN f USING (symbol, entry_idx, side))
SELECT symbol, entry_idx, side, round(CASE WHEN late THEN forced ELSE rr END, 6) AS rr, CASE WHEN late THEN false ELSE hit END AS hit, CASE WHEN late THEN cut ELSE exit_idx END AS exit_idx
FROM e WHERE CASE WHEN late THEN cut > entry_idx ELSE exit_idx IS NOT NULL END"""


def bracket(spark, sf, name, tick=None, cutoff=None):
    """Every trade of a bracket target over bars by event type, to the end of the data."""
    b = materialize(with_recursive(by_type(spark, sf)), "bars")
    return r6(T.resolve(T.levels(b, T.BRACKETS[name], tick), b, cutoff), "rr")


@query("bracket_2atr", _bracket_sql("atr", "2.0 * atr"))
def bracket_2atr(spark, sf):
    return bracket(spark, sf, "2x_atr_tp_atr_stop")


@query("bracket_3atr", _bracket_sql("atr", "3.0 * atr"))
def bracket_3atr(spark, sf):
    return bracket(spark, sf, "3x_atr_tp_atr_stop")


@query("bracket_1atr", _bracket_sql("atr", "1.0 * atr"))
def bracket_1atr(spark, sf):
    return bracket(spark, sf, "atr_tp_atr_stop")


@query("bracket_highlow_or_atr", _bracket_sql("wide", "2.0 * atr"))
def bracket_highlow_or_atr(spark, sf):
    return bracket(spark, sf, "highlow_or_atr")


@query("bracket_tightest_stop", _bracket_sql("tightest", "2.0 * atr"))
def bracket_tightest_stop(spark, sf):
    return bracket(spark, sf, "highlow_or_atr_tightest_stop")


@query("bracket_highlow_2atr_rr", _bracket_sql("highlow", "2.0 * atr", min_rr=True))
def bracket_highlow_2atr_rr(spark, sf):
    return bracket(spark, sf, "highlow_sl_2x_atr_tp_rr_gt_1")


@query("bracket_highlow_1atr_rr", _bracket_sql("highlow", "1.0 * atr", min_rr=True))
def bracket_highlow_1atr_rr(spark, sf):
    return bracket(spark, sf, "highlow_sl_1x_atr_tp_rr_gt_1")


@query("bracket_ticks_and_end", _bracket_sql("wide", "2.0 * atr", tick=0.25, end="2024-01-15"))
def bracket_ticks_and_end(spark, sf):
    """Stops and targets on the tick grid; trades opened by the last day of a range are closed with it."""
    return bracket(spark, sf, "highlow_or_atr", 0.25, F.to_date("ts") <= F.lit("2024-01-15").cast("date"))


@query("bracket_labels", _bracket_sql("atr", "2.0 * atr").replace(" SELECT symbol, entry_idx, side, round(rr, 6) AS rr, hit, exit_idx FROM f", """ SELECT b.symbol, b.bar_idx,
  coalesce(x.hit, false) AS label, round(x.rr, 6) AS rr_long, round(y.rr, 6) AS rr_short, x.exit_idx AS exit_i FROM bars b
  LEFT JOIN (SELECT * FROM f WHERE side = 1) x ON x.symbol = b.symbol AND x.entry_idx = b.bar_idx LEFT JOIN (SELECT * FROM f WHERE side = -1) y ON y.symbol = b.symbol AND y.entry_idx = b.bar_idx"""))
def bracket_labels(spark, sf):
    """The columns that a bracket target adds to every bar."""
    b = materialize(with_recursive(by_type(spark, sf)), "bars")
    t = T.with_bracket(b, "2x_atr_tp_atr_stop")
    return r6(t.select("symbol", "bar_idx", F.col("2x_atr_tp_atr_stop").alias("label"), "rr_long", "rr_short", F.col("2x_atr_tp_atr_stop_exit_i").alias("exit_i")), "rr_long", "rr_short")


_FIRST_TWO = """
f1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, period ORDER BY i) AS k FROM x),
one AS (SELECT * FROM f1 WHERE k = 1),
two AS (SELECT x.*, row_number() OVER (PARTITION BY x.symbol, x.side, x.period ORDER BY x.i) AS k FROM x JOIN one ON one.symbol = x.symbol AND one.side = x.side AND one.period = x.period AND x.i > one.at {more}),
z AS (SELECT * FROM one UNION ALL SELECT * FROM two WHERE k = 1)"""


def _backtest_sql(period: str, signal: str, stop_after_win: bool, select: str) -> str:
    """At most two trades a period and side, the second after the first is closed: a candidate's exit by a join with its period's later bars."""
    return _ATR + f""",
q AS (SELECT t.*, rec.atr, {period} AS period FROM tr t JOIN rec USING (symbol, bar_idx)),
e AS (SELECT *, max(bar_idx) OVER (PARTITION BY symbol, period) AS last, arg_max(close, bar_idx) OVER (PARTITION BY symbol, period) AS final FROM q),
c AS (SELECT e.symbol, s.side, period, bar_idx AS i, close AS entry, close + s.side * 2.0 * atr AS tp, last, final, CASE WHEN s.side = 1 THEN low ELSE high END AS far, close - s.side * atr AS near
  FROM e, (SELECT unnest([1, -1]) AS side) s WHERE {signal}),
d AS (SELECT *, {_STOPS["tightest"].replace("close", "entry").replace("ELSE near END", "WHEN (entry - near) * side > 0 THEN near END")} AS stop FROM c),
g AS (SELECT * FROM d WHERE (entry - stop) * side > 1e-9 AND (tp - entry) * side > 0),
h AS (SELECT g.symbol, g.side, g.i, min(b.bar_idx) AS j, arg_min(CASE WHEN (CASE WHEN side = 1 THEN b.low ELSE b.high END - stop) * side <= 0 THEN stop ELSE tp END, b.bar_idx) AS price
  FROM g JOIN bars b ON b.symbol = g.symbol AND b.bar_idx > g.i AND b.bar_idx <= g.last
  WHERE (CASE WHEN side = 1 THEN b.low ELSE b.high END - stop) * side <= 0 OR (CASE WHEN side = 1 THEN b.high ELSE b.low END - tp) * side >= 0 GROUP BY ALL),
x AS (SELECT g.*, coalesce(h.j, g.last) AS at, coalesce(h.price, g.final) AS price, (coalesce(h.price, g.final) - g.entry) / (g.entry - g.stop) AS rr FROM g LEFT JOIN h USING (symbol, side, i)),""" + _FIRST_TWO.format(more="AND one.rr <= 0" if stop_after_win else "") + select


_WEEK = "greatest(0, floor((epoch(bts) - 338400) / 604800))::BIGINT"


@query("tribar_weekly", _RECURRENCES[: _RECURRENCES.index("d0 AS")] + f"""
o AS (SELECT *, greatest(open, close) AS top, least(open, close) AS bottom, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS nr, {_WEEK} AS period FROM t),
m AS (SELECT *, max(bar_idx) OVER (PARTITION BY symbol, period) AS last, greatest(lag(top) OVER w, lag(top, 2) OVER w) AS tops, least(lag(bottom) OVER w, lag(bottom, 2) OVER w) AS bottoms FROM o WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
c AS (SELECT m.symbol, 1 AS side, m.period, m.bar_idx AS i, m.close AS entry, m.high, m.low, m.last, least(m.low, m.close - r1.s_tr) AS stop, m.close + 2 * r1.s_tr AS tp FROM m JOIN r1 USING (symbol, bar_idx)
  WHERE nr > 2 AND ((m.close > m.open AND m.close > tops) OR (m.close < m.open AND m.close < bottoms)) AND m.close > r1.kf_smooth),
g AS (SELECT * FROM c WHERE stop < entry),
h AS (SELECT g.symbol, g.i, min(b.bar_idx) AS j, arg_min(CASE WHEN b.open <= stop THEN [(b.open - entry) / (entry - stop), 0.0] WHEN b.open >= tp THEN [(b.open - entry) / (entry - stop), 1.0] WHEN b.low <= stop THEN [-1.0, 0.0] ELSE [(tp - entry) / (entry - stop), 1.0] END, b.bar_idx) AS r
  FROM g JOIN bars b ON b.symbol = g.symbol AND b.bar_idx > g.i AND b.bar_idx <= g.last WHERE b.open <= stop OR b.open >= tp OR b.low <= stop OR b.high >= tp GROUP BY ALL),
y AS (SELECT g.*, CASE WHEN g.high >= tp AND g.low > stop THEN [(tp - entry) / (entry - stop), 1.0, i] WHEN g.low <= stop THEN [-1.0, 0.0, i] WHEN h.j IS NOT NULL THEN [h.r[1], h.r[2], h.j] WHEN g.last > g.i THEN [(b.close - entry) / (entry - stop), 0.0, g.last] END AS r
  FROM g LEFT JOIN h USING (symbol, i) JOIN bars b ON b.symbol = g.symbol AND b.bar_idx = g.last),
x AS (SELECT *, r[3]::BIGINT AS at FROM y WHERE r IS NOT NULL),""" + _FIRST_TWO.format(more="") + """
SELECT symbol, i AS bar_idx, r[2] = 1 AS tribar_4h_2atr, round(r[1], 6) AS rr_tribar_4h_2atr, z.at AS tribar_4h_2atr_exit_i FROM z""")
def tribar_weekly(spark, sf):
    b = FE.rich_features(by_type(spark, sf)).select("symbol", "ts", "bar_idx", "open", "high", "low", "close", "atr", "kf_smooth", "is_tribar")
    out = T.tribar_4h_2atr(materialize(b, "bars")).where("tribar_4h_2atr_eligible")
    return r6(out.select("symbol", "bar_idx", "tribar_4h_2atr", "rr_tribar_4h_2atr", "tribar_4h_2atr_exit_i"), "rr_tribar_4h_2atr")


@query("backtest_weekly", _backtest_sql(_WEEK, "close > open", False, """
SELECT symbol, CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS direction, i AS entry_idx, z.at AS exit_idx, round(entry, 6) AS entry_price, round(price, 6) AS exit_price, round(rr, 6) AS rr, period,
  round(stop, 6) AS stop_price, round(tp, 6) AS tp_price FROM z"""))
def backtest_weekly(spark, sf):
    return r6(B.backtest(by_type(spark, sf), B.Plan("close > open")), "entry_price", "exit_price", "rr", "stop_price", "tp_price")


@query("backtest_monthly", _backtest_sql("(year(bts) * 12 + month(bts) - 1)::BIGINT", "close > open AND volume >= 2", True, """
SELECT CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS direction, count(*) AS trades, count(*) FILTER (rr > 0) AS wins, count(*) FILTER (rr < 0) AS losses, round(avg(rr), 6) AS avg_rr, round(max(rr), 6) AS best_rr, round(min(rr), 6) AS worst_rr
FROM z GROUP BY 1"""))
def backtest_monthly(spark, sf):
    out = B.summary(B.backtest(by_type(spark, sf), B.Plan("close > open && volume >= 2", period="monthly", stop_after_win=True)))
    return r6(out, "avg_rr", "best_rr", "worst_rr")


_NICE = lambda v, down: f"""CASE WHEN {v} = 0 THEN 0.0::DOUBLE WHEN {v} < 0 THEN {"-1" if down else "-10"} * pow(10, floor(log10(-{v}))) ELSE
  {"list_max" if down else "list_min"}(list_filter([m * pow(10, floor(log10({v}))) FOR m IN [1, 2, 5, 10]], lambda x: x {"<=" if down else ">="} {v})) END"""  # noqa: E731


@query("threshold_catalog", "WITH RECURSIVE " + _bars("e.event_type") + FEATS + f""",
b AS (SELECT 'range' AS base, high - low AS v FROM feats UNION ALL SELECT 'body', close - open FROM feats UNION ALL SELECT 'sma_9', sma_9 FROM feats),
q AS (SELECT base, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS z, CASE base WHEN 'range' THEN ['>'] WHEN 'body' THEN ['>', '<'] ELSE ['>=', '<='] END AS ops FROM b WHERE v IS NOT NULL GROUP BY 1),
n AS (SELECT base, ops, {_NICE("a", True)} AS low, {_NICE("z", False)} AS high FROM q),
s AS (SELECT n.*, m * pow(10, e) AS step, len(ops) * floor((high - low) / (m * pow(10, e))) AS made, (high - low) * len(ops) / (10 + len(ops)) AS even FROM n, (SELECT unnest(range(-5, 4)) AS e), (SELECT unnest([1, 2, 5]) AS m)),
k AS (SELECT DISTINCT ON (base) * FROM s ORDER BY base, CASE WHEN made BETWEEN 5 AND 15 THEN 0 ELSE 1 END, CASE WHEN made BETWEEN 5 AND 15 THEN abs(made - 10) ELSE abs(step - even) END, step),
g AS (SELECT base, ops, low, high, step, low AS x FROM k UNION ALL SELECT base, ops, low, high, step, x + step FROM g WHERE x + step <= high + 2.220446049250313e-16),
o AS (SELECT base, unnest(ops) AS op, unnest(range(1, len(ops) + 1)) AS place, low, high, x FROM g WHERE x <= high + 2.220446049250313e-16),
h AS (SELECT *, base || op || CAST(CAST(printf('%.2f', x) AS DOUBLE) AS VARCHAR) AS name FROM o WHERE CASE op WHEN '>' THEN high > x WHEN '>=' THEN high >= x WHEN '<' THEN low < x ELSE low <= x END),
u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY name ORDER BY place, x) = 1)
SELECT (row_number() OVER (ORDER BY base, place, x) - 1)::INTEGER AS idx, name, 'feature_vs_constant' AS category, base, op, round(x, 6) AS threshold, NULL::VARCHAR AS rhs FROM u""")
def threshold_catalog(spark, sf):
    df = materialize(FE.builtin_features(by_type(spark, sf)), "bars")
    return r6(K.catalog_frame(spark, K.threshold_entries(df, {"range": (">",), "body": (">", "<"), "sma_9": (">=", "<=")})), "threshold")
