"""Run configuration and the command line that resolves it."""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass, field

from comboscan.operators.metrics import Sizing, asset
from comboscan.sources.store import parse_s3

STOP_COLUMNS = {"2x_atr_tp_atr_stop": "atr", "atr_stop": "atr", "3x_atr_tp_atr_stop": "atr", "atr_tp_atr_stop": "atr"}


@dataclass(frozen=True)
class Config:
    data: str
    out: str
    target: str = "next_bar_up"
    direction: str = "long"
    depth: int = 2
    min_samples: int = 100
    max_drawdown: float = 30.0
    min_calmar: float | None = None
    start: str | None = None
    end: str | None = None
    offset: int | None = None  # None: where the run stopped
    max_combos: int | None = None  # absolute, from rank 0
    batch: int = 200_000
    stacking: bool = True
    feature_pairs: bool = False
    pair_limit: int | None = None
    require_any: tuple[str, ...] = ()
    rich: bool = False
    top: int = 5
    cost_r: float = 0.0
    force: bool = False
    dry_run: bool = False
    sizing: Sizing = field(default_factory=Sizing)
    stop_column: str | None = None
    point_value: float | None = None
    tick: float | None = None
    subset_pruning: bool = False
    auto_batch: bool = False
    formulas_only: bool = False
    profile: str = "off"  # coarse: counts of each window in the log; fine: seconds too
    profile_every: int = 1
    windows: int = 2  # under way at a time
    min_samples_report: int | None = None
    max_drawdown_report: float | None = None
    stats: str = "core"  # full: all statistics of the top combinations, worked out again
    stop_unit: str = "points"
    keep_prepared: bool = False
    acknowledge: bool = False
    upload: str | None = None
    upload_each: bool = False
    quiet: bool = False
    show: bool = True

    def run_key(self) -> dict:
        """What a resumed run must agree on; offsets, limits and reports may differ."""
        free = ("out", "offset", "max_combos", "batch", "top", "force", "dry_run", "min_calmar", "subset_pruning", "auto_batch", "formulas_only", "profile", "profile_every", "windows",
                "min_samples_report", "max_drawdown_report", "stats", "keep_prepared", "acknowledge", "upload", "upload_each", "quiet", "show")
        return {k: v for k, v in asdict(self).items() if k not in free}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="comboscan")
    commands = p.add_subparsers(dest="command", required=True)
    r = commands.add_parser("results", help="the best stored combinations")
    r.add_argument("--out", "--output-dir", required=True)
    r.add_argument("--direction")
    r.add_argument("--target")
    r.add_argument("--min-samples", type=int, default=0)
    r.add_argument("--min-win-rate", type=float)
    r.add_argument("--max-drawdown", type=float, default=float("inf"))
    r.add_argument("--limit", type=int, default=20)
    b = commands.add_parser("backtest", help="trades of an entry expression, capped by period")
    b.add_argument("--data", "--csv", required=True)
    b.add_argument("--out", "--output-dir", required=True)
    b.add_argument("--entry", required=True)
    b.add_argument("--period", choices=["weekly", "monthly"], default="weekly")
    b.add_argument("--stop-after-win", action="store_true")
    c = commands.add_parser("comb", help="search AND-combinations of predicates")
    c.add_argument("--data", "--csv", required=True)
    c.add_argument("--out", "--output-dir", required=True)
    c.add_argument("--target", default="next_bar_color_and_wicks")
    c.add_argument("--direction", choices=["long", "short", "both"], default="long")
    c.add_argument("--depth", "--max-depth", type=int, default=3)
    c.add_argument("--min-samples", "--min-sample-size", type=int, default=100)
    c.add_argument("--min-samples-report", type=int, help="least trades in the report, in place of --min-samples")
    c.add_argument("--max-drawdown", type=float, default=30.0)
    c.add_argument("--max-drawdown-report", type=float, help="in the report, in place of --max-drawdown")
    c.add_argument("--min-calmar", "--min-calmar-report", type=float)
    c.add_argument("--start", "--date-start")
    c.add_argument("--end", "--date-end")
    c.add_argument("--offset", "--resume-from", "--resume-offset", type=int)
    c.add_argument("--max-combos", "--limit", type=int)
    c.add_argument("--batch", "--batch-size", type=int, default=20_000)
    c.add_argument("--stacking-mode", choices=["stacking", "no-stacking"], default="no-stacking")
    c.add_argument("--no-stacking", dest="stacking_mode", action="store_const", const="no-stacking")
    c.add_argument("--feature-pairs", "--enable-feature-pairs", action="store_true")
    c.add_argument("--pair-limit", "--feature-pairs-limit", "--feature-pairs-max", type=int)
    c.add_argument("--require-any", "--require-any-features", action="append", default=[], help="names, also several with commas")
    c.add_argument("--rich", action="store_true", help="all indicators instead of the small set")
    c.add_argument("--top", "--report-top", "--top-k", type=int, default=5)
    c.add_argument("--force", "--force-recompute", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--asset")
    c.add_argument("--capital", type=float, default=100_000.0)
    c.add_argument("--risk-pct", "--risk-pct-per-trade", type=float, default=1.0)
    c.add_argument("--sizing", "--position-sizing", choices=["fractional", "contracts"], default="fractional")
    c.add_argument("--stop-column", "--stop-distance-column")
    c.add_argument("--stop-distance-unit", choices=["points", "ticks"], default="points")
    c.add_argument("--no-costs", action="store_true", help="rewards as they are, whatever the asset costs")
    c.add_argument("--stats-detail", choices=["core", "full"], default="core")
    c.add_argument("--report", "--report-metrics", choices=["full", "formulas", "off"], default="full")
    c.add_argument("--ack-new-df", action="store_true", help="replace prepared data that differ")
    c.add_argument("--s3-output", help="s3://bucket/prefix the results are copied to at the end")
    c.add_argument("--s3-upload-each-batch", action="store_true")
    c.add_argument("--quiet", action="store_true")
    c.add_argument("--cost-r", "--cost-per-trade-r", type=float)
    c.add_argument("--commission", "--commission-per-trade-dollar", type=float, help="round trip, in dollars")
    c.add_argument("--slippage", "--slippage-per-trade-dollar", type=float, help="round trip, in dollars")
    c.add_argument("--cost", "--cost-per-trade-dollar", type=float, help="round trip, in place of commission and slippage")
    c.add_argument("--dollars-per-r", type=float)
    c.add_argument("--tick", "--tick-size", type=float)
    c.add_argument("--margin", "--margin-per-contract-dollar", type=float)
    c.add_argument("--point-value", type=float)
    c.add_argument("--subset-pruning", "--enable-subset-pruning", action="store_true", help="skip deeper combinations of pairs with too few trades")
    c.add_argument("--auto-batch", action="store_true", help="let windows grow and shrink with their time")
    c.add_argument("--formulas-only", action="store_true", help="report names alone")
    c.add_argument("--profile-eval", dest="profile", choices=["off", "coarse", "fine"], default="off", help="log what each window cost")
    c.add_argument("--profile-eval-sample-rate", dest="profile_every", type=int, default=1, help="profile every so many windows")
    c.add_argument("--windows", type=int, default=2, help="windows of ranks under way at a time")
    c.add_argument("--min-contracts", type=int, default=1)
    c.add_argument("--max-contracts", type=int)
    return p


def trade_cost(a: argparse.Namespace, known: dict[str, float] | None) -> float | None:
    """Dollars of a round trip: given as a whole, or commission and slippage, each given or the asset's; None where nothing says."""
    if a.cost is not None:
        return a.cost
    if known is None and a.commission is None and a.slippage is None:
        return None
    fees, slip = (2.0 * known["commission_per_side"], known["slippage_ticks"] * known["tick_value"]) if known else (0.0, 0.0)
    return (fees if a.commission is None else a.commission) + (slip if a.slippage is None else a.slippage)


def resolve(argv: list[str]) -> Config:
    """Config of a command line; contracts sizing needs an asset (or a point value) and a stop distance, which ATR targets imply.

    Costs are taken from rewards: in R for fractional sizing (dollars over the dollars of one R), in dollars for contracts."""
    a = parser().parse_args(argv)
    known = asset(a.asset) if a.asset else None
    target = {"atr_stop": "2x_atr_tp_atr_stop"}.get(a.target, a.target)
    stop = a.stop_column or STOP_COLUMNS.get(a.target)
    point = a.point_value if a.point_value is not None else known["point_value"] if known else None
    if a.sizing == "contracts" and (point is None or stop is None):
        raise ValueError("contracts sizing needs --asset or --point-value, and a stop column")
    per_r = a.dollars_per_r or a.capital * a.risk_pct / 100
    dollars = trade_cost(a, known)
    if a.no_costs:
        cost = 0.0
    elif a.sizing == "contracts":
        cost = dollars or 0.0
    else:
        cost = a.cost_r if a.cost_r is not None else dollars / per_r if dollars is not None and per_r > 0 else 0.0
    tick = a.tick if a.tick is not None else known["tick_size"] if known else None
    if a.stop_distance_unit == "ticks" and not tick:
        raise ValueError("a stop distance in ticks needs --asset or --tick")
    if a.s3_output:
        parse_s3(a.s3_output)
    margin = a.margin if a.margin is not None else known["margin"] if known else None
    return Config(
        data=a.data, out=a.out, target=target, direction=a.direction, depth=a.depth, min_samples=a.min_samples, max_drawdown=a.max_drawdown,
        min_calmar=a.min_calmar, start=a.start, end=a.end, offset=a.offset, max_combos=a.max_combos, batch=a.batch, stacking=a.stacking_mode == "stacking",
        feature_pairs=a.feature_pairs, pair_limit=a.pair_limit, require_any=tuple(x for names in a.require_any for x in names.split(",") if x), rich=a.rich, top=a.top, cost_r=cost,
        force=a.force, dry_run=a.dry_run, sizing=Sizing(a.sizing, a.capital, a.risk_pct, per_r, a.min_contracts, a.max_contracts, margin),
        stop_column=stop, point_value=point, tick=tick,
        subset_pruning=a.subset_pruning, auto_batch=a.auto_batch, formulas_only=a.formulas_only or a.report == "formulas",
        min_samples_report=a.min_samples_report, max_drawdown_report=a.max_drawdown_report, stats=a.stats_detail, stop_unit=a.stop_distance_unit, keep_prepared=True,
        acknowledge=a.ack_new_df, upload=a.s3_output, upload_each=a.s3_upload_each_batch, quiet=a.quiet, show=a.report != "off",
        profile=a.profile, profile_every=max(1, a.profile_every), windows=a.windows,
    )
