"""The search from raw bars to ranked results: prepare, catalog, prune, enumerate by windows of ranks, store, report."""

from __future__ import annotations

import logging
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, datetime
from time import monotonic

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.operators import catalog as K
from comboscan.operators import combos as X
from comboscan.operators import features as FE
from comboscan.operators import metrics as M
from comboscan.operators import search as Q
from comboscan.operators import targets as T
from comboscan.plans.config import Config
from comboscan.plans.report import BatchTuner, format_report
from comboscan.session import materialize, ship_package
from comboscan.sources import bars as S
from comboscan.sources import store as ST

log = logging.getLogger("comboscan")


@dataclass
class Prepared:
    data: DataFrame
    entries: list[K.Entry]
    pruned: dict[str, int]
    years: float


def prepare(spark: SparkSession, bars: DataFrame, cfg: Config) -> Prepared:
    """Features on all history, then the target, the date range, and a pruned catalog."""
    df = FE.rich_features(bars) if cfg.rich else FE.builtin_features(bars)
    if cfg.rich:  # rows before the longest mean is there take no part
        df = materialize(df, "features")
        df = S.drop_missing(df, K.core_columns(df))
    if cfg.rich and cfg.target in T.STOPPED:
        df = T.next_bar_with_stop(df, T.STOPPED[cfg.target], cfg.target, cfg.tick)
        if cfg.direction == "short":
            df = df.withColumns({cfg.target: F.col(f"{cfg.target}_short"), f"rr_{cfg.target}": F.col("rr_short"), f"{cfg.target}_eligible": F.col("rr_short").isNotNull()})
    elif cfg.target in T.BRACKETS or cfg.target in T.ALIASES:
        df = materialize(df if "atr" in df.columns else FE.with_recursive(df), "features")
        ts = "ts" if "ts" in df.columns else "timestamp"
        # a trade opened within the dates is closed with them: nothing later may decide it
        cutoff = S.day_of(df, ts) <= F.lit(cfg.end).cast("date") if cfg.end else None
        df = T.with_bracket(df, cfg.target, cfg.direction, cfg.tick, cutoff=cutoff)
    elif cfg.target == "tribar_4h_2atr":
        df = T.tribar_4h_2atr(df)
    else:
        df = T.next_bar(df, cfg.target)
    ts = "ts" if "ts" in df.columns else "timestamp"
    if cfg.keep_prepared and not cfg.dry_run:
        S.write_prepared(df, f"{cfg.out.rstrip('/')}/prepared", cfg.acknowledge)
    df = materialize(S.date_filter(df, cfg.start, cfg.end, ts), "prepared")
    if cfg.rich and not cfg.quiet:
        for line in K.audit(df).lines():
            log.info("audit: %s", line)
    entries = K.rich_catalog(df, cfg.feature_pairs, cfg.pair_limit) if cfg.rich else K.builtin_catalog(df, cfg.feature_pairs)
    kept, why = K.prune(df, entries, cfg.target, f"rr_{cfg.target}", cfg.min_samples)
    if cfg.rich:  # flags that never change, or that repeat an earlier one
        flags = [e.name for e in kept if e.category == "boolean"]
        alive = set(X.first_of_equal_masks(df, flags)) if flags else set()
        why["equal_flags"] = len(flags) - len(alive)
        kept = [e for e in kept if e.category != "boolean" or e.name in alive]
    return Prepared(df, kept, why, M.span_years(df, ts))


def run(spark: SparkSession, bars: DataFrame, cfg: Config, data_digest: str) -> DataFrame | None:
    """Runs (or goes on with) a search over one symbol's bars and returns the top of all stored results; None for a dry run."""
    ship_package(spark)
    p = prepare(spark, bars, cfg)
    n = len(p.entries)
    last = X.total(n, cfg.depth)
    log.info("catalog %d, pruned %s, combinations %d", n, p.pruned, last)
    if cfg.dry_run:
        return None
    store = ST.Store(spark, cfg.out, data_digest, ST.run_digest(cfg.run_key() | {"catalog": K.catalog_digest(p.entries)}), cfg.force)
    compared = [c for e in p.entries for c in (e.predicate.base, e.predicate.rhs) if c]
    needed = S.required_columns(p.data.columns, cfg.target, [e.name for e in p.entries], [*compared, *([cfg.stop_column] if cfg.stop_column else [])])
    masked = K.with_masks(p.data.select(*[f"`{c}`" for c in needed]), p.entries)
    rpc = M.risk_per_contract(stop_distance(cfg), cfg.point_value) if cfg.sizing.mode == "contracts" else None
    net = M.net_reward(C.num(f"rr_{cfg.target}"), cfg.cost_r, cfg.sizing.mode, rpc)
    masked = materialize(masked.withColumn("_net", net), "masked")
    names = [e.name for e in p.entries]
    blocks = Q.pack(masked, names, cfg.target, "_net", rpc)
    if blocks.df.select("symbol").distinct().count() > 1:
        raise ValueError("a run takes the bars of one symbol")
    preds = [e.predicate for e in p.entries]
    s = cfg.sizing
    capital = X.Capital(s.risk_pct / 100.0, float(s.capital), p.years, s.mode == "contracts", s.min_contracts, s.max_contracts, s.margin)
    dead = None
    if cfg.subset_pruning and cfg.depth > 2:
        key = ST.run_digest({"catalog": K.catalog_digest(p.entries), "masks": S.digest(blocks.df.select("symbol", "block", "flags", "gate")), "need": cfg.min_samples})
        dead = Q.pair_bits(store.cached("pairs", key, lambda: Q.dead_pairs(blocks, cfg.min_samples)), n)
    tuner = BatchTuner(cfg.batch) if cfg.auto_batch else None
    end = min(last, cfg.max_combos) if cfg.max_combos is not None else last
    at = store.offset() if cfg.offset is None else cfg.offset

    def window(a: int, b: int) -> float:
        """Judges a window and writes its rows; the state names it later, in order."""
        began = monotonic()
        profiled = cfg.profile != "off" and (a // max(1, cfg.batch)) % cfg.profile_every == 0
        seen = Observation() if profiled else None
        found = Q.search(blocks, preds, cfg.depth, a, b, cfg.stacking, cfg.min_samples, set(cfg.require_any), dead, capital, profile=seen)
        store.write(result_rows(found.where(F.col("max_drawdown") <= cfg.max_drawdown), cfg, data_digest), a, b)
        if seen is not None:
            log.info("%s", profile_line(a, b, seen.get, cfg.profile))
        return monotonic() - began

    for a, b, seconds in in_order(spark, window, at, end, lambda: tuner.size if tuner else cfg.batch, cfg.windows):
        store.name(a, b)
        if tuner:
            tuner.record(seconds)
        if cfg.upload and cfg.upload_each:
            store.copy(cfg.upload)
    if cfg.upload:
        store.copy(cfg.upload)
    top = ST.top_results(store.results(check=True), cfg.top, cfg.min_samples_report or cfg.min_samples, cfg.max_drawdown_report or cfg.max_drawdown, cfg.min_calmar)
    return report(materialize(top, "top"), masked, cfg, p) if cfg.stats == "full" else top


def in_order(spark: SparkSession, window: Callable[[int, int], float], at: int, end: int, size: Callable[[], int], flight: int) -> Iterator[tuple[int, int, float]]:
    """(start, end, seconds) of windows in order, ``flight`` of them under way at a time, so that the cores left by one's last tasks
    and by its commit judge the next. Where one fails, the jobs of all are cancelled by their tag and the failure is raised."""
    sc, tag = spark.sparkContext, f"windows-{uuid.uuid4().hex}"

    def job(a: int, b: int) -> float:
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", f"window-{a}")
        return window(a, b)

    waiting: deque[tuple[int, int, Future]] = deque()
    with ThreadPoolExecutor(max(1, flight)) as pool:
        try:
            while waiting or at < end:
                while at < end and len(waiting) < max(1, flight):
                    to = min(end, at + size())
                    waiting.append((at, to, pool.submit(job, at, to)))
                    at = to
                a, b, done = waiting.popleft()
                yield a, b, done.result()
        finally:
            if any(not f.done() for *_, f in waiting):
                sc.cancelJobsWithTag(tag)


def profile_line(a: int, b: int, seen: dict, detail: str) -> str:
    """Counts of a window; ``fine`` adds the seconds its tasks spent on ANDs and on statistics."""
    looked, kept = seen["looked"] or 0, seen["kept"]
    line = f"window {a}-{b}: {b - a} combinations, {looked} masks ANDed, {kept} kept"
    return line if detail == "coarse" else f"{line}; {seen['and_seconds'] or 0.0:.2f} s of ANDs, {seen['stat_seconds'] or 0.0:.2f} s of statistics"


def stop_distance(cfg: Config) -> Column:
    """The stop distance in points; of a column in ticks, times the tick."""
    d = C.num(cfg.stop_column)
    return d * cfg.tick if cfg.stop_unit == "ticks" else d


def result_rows(found: DataFrame, cfg: Config, digest: str) -> DataFrame:
    """The stored columns."""
    now = datetime.now(UTC).isoformat()
    win = 100.0 * F.col("profitable_bars") / F.col("total_bars")
    return found.select(
        F.lit(digest).alias("csv_hash"), F.lit(cfg.direction).alias("direction"), F.lit(cfg.target).alias("target"), "combination", F.lit(now).alias("processed_at"),
        F.col("combo_id").alias("resume_offset"), "depth", "total_bars", "profitable_bars", win.alias("win_rate"), "max_drawdown", "calmar_ratio",
    )


def combination_trades(combos: DataFrame, masked: DataFrame, cfg: Config, names: list[str]) -> DataFrame:
    """Trades of listed combinations: each bar's true names against each combination's parts, counted."""
    rpc = M.risk_per_contract(stop_distance(cfg), cfg.point_value).alias("rpc") if cfg.sizing.mode == "contracts" else F.lit(1.0).alias("rpc")
    t = M.trades(masked, {n: F.col(f"`{n}`") for n in names}, cfg.target, F.col("_net")).withColumnRenamed("combination", "part")
    parts = combos.withColumn("parts", F.split("combination", " && ")).withColumn("need", F.size("parts")).select("combination", "need", F.explode("parts").alias("part"))
    whole = t.join(parts, "part").groupBy("combination", "symbol", "bar_idx").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need"), *[F.first(c).alias(c) for c in ("rr", "label", "exit_i")])
    whole = whole.where("have = need").drop("have", "need")
    if not cfg.stacking:
        whole = M.without_stacking(whole)
    return whole.join(masked.select("symbol", "bar_idx", rpc), ["symbol", "bar_idx"])


def report(top: DataFrame, masked: DataFrame, cfg: Config, p: Prepared) -> DataFrame:
    """Full statistics of the top combinations, recomputed; with a capital path also in dollars."""
    t = materialize(combination_trades(top.select("combination"), masked, cfg, [e.name for e in p.entries]), "trades")
    stats = M.full_stats(t, p.years).withColumn("quality", M.sample_quality(F.col("total_bars")))
    path = M.equity(t, cfg.sizing, "rpc" if cfg.sizing.mode == "contracts" else None, p.years)
    if cfg.sizing.mode == "contracts":
        sized = t.withColumn("n", F.floor(F.lit(float(cfg.sizing.capital)) * cfg.sizing.risk_pct / 100.0 / F.col("rpc")))
        path = path.join(sized.groupBy("combination", "symbol").agg(F.median("n").alias("contracts_median"), F.max("n").alias("contracts_most")), ["combination", "symbol"], "left")
    out = stats.join(path, ["combination", "symbol"], "left")
    return out.withColumns({
        "net_profit_dollar": F.col("final_capital") - F.lit(float(cfg.sizing.capital)), "max_drawdown_dollar": F.col("equity_max_dd"),
        "expectancy_dollar": (F.col("final_capital") - F.lit(float(cfg.sizing.capital))) / F.col("total_bars"),
    }).orderBy(F.desc("calmar_ratio"), "combination")


def main(argv: list[str]) -> None:
    from comboscan.plans.config import parser, resolve

    logging.basicConfig(level=logging.INFO)
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("comboscan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "results":
        ST.top_results(ST.committed(spark, a.out), a.limit, a.min_samples, a.max_drawdown, None, a.direction, a.target, a.min_win_rate).show(a.limit, truncate=False)
        return
    bars = S.read_bars(spark, a.data).withColumnRenamed("timestamp", "ts")
    if a.command == "backtest":
        from comboscan.operators import backtest as B

        plan = B.Plan(a.entry, period=a.period, stop_after_win=a.stop_after_win)
        trades = materialize(B.backtest(bars, plan), "backtest")
        trades.write.mode("overwrite").option("header", True).csv(f"{a.out.rstrip('/')}/backtest")
        B.summary(trades).show(truncate=False)
        return
    cfg = resolve(argv)
    if cfg.quiet:
        log.setLevel(logging.WARNING)
    top = run(spark, bars, cfg, S.fingerprint(spark, cfg.data))
    if top is not None and cfg.show:
        print(format_report(top, cfg.formulas_only))
