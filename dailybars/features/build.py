"""Daily feature tables: bars in, one row per bar with the chosen features out."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from dailybars.features import v3_composite, v3_periods  # noqa: F401  (fill the registry)
from dailybars.features.v3_market import WITHOUT_MARKET
from dailybars.features.v3_periods import MONTHLY, WEEKLY
from dailybars.features.v3_price import V3
from dailybars.features.v1_v2 import V1, V2
from dailybars.features.windows import WINDOWS
from dailybars.functions.terms import Sheet
from dailybars.plans.asof import spread_days
from dailybars.plans.cut import written
from dailybars.plans.blocks import BLOCK_ROWS, into_blocks, number_rows
from dailybars.plans.kernels import add_kernels, kernels
from dailybars.plans.runs import add_anchored_runs, add_jump_runs, fill_forward
from dailybars.plans.sheets import run_sheet

SETS = {"v1": V1, "v2": V2, "v3": V3, "windows": WINDOWS}

# Sector -> reference symbol, and the symbols used before two of them existed.
SECTOR_SYMBOL = {
    "Technology": "XLK", "Financial Services": "XLF", "Healthcare": "XLV", "Energy": "XLE",
    "Industrials": "XLI", "Consumer Cyclical": "XLY", "Consumer Defensive": "XLP",
    "Basic Materials": "XLB", "Utilities": "XLU", "Communication Services": "XLC", "Real Estate": "XLRE",
}
BEFORE_LAUNCH = {"XLC": ("2018-09-28", "XLK"), "XLRE": ("2015-10-07", "XLF")}


def price_columns(bars: DataFrame, raw: bool = False) -> DataFrame:
    """ticker, date, o, h, l, c, vol; c is the adjusted close where the table has one. ``raw`` adds close and volume as given."""
    close = "adj_close" if "adj_close" in [c.lower() for c in bars.columns] else "close"
    return bars.select("ticker", "date", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                       F.col(close).alias("c"), F.col("volume").cast("double").alias("vol"), *(["close", "volume"] if raw else []))


def sector_symbols(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """ticker, symbol: the sector's reference symbol as of the ticker's first date."""
    first = bars.groupBy("ticker").agg(F.min("date").alias("first_date"))
    symbol = F.create_map(*[F.lit(x) for kv in SECTOR_SYMBOL.items() for x in kv])[F.col("sector")]
    chosen = symbol
    for late, (launch, stand_in) in BEFORE_LAUNCH.items():
        early = (symbol == late) & (F.col("first_date") < F.to_date(F.lit(launch)))
        chosen = F.when(early, stand_in).otherwise(chosen)
    return first.join(sectors, "ticker").select("ticker", chosen.alias("symbol")).where("symbol is not null")


def week_label(date="date"):
    """Friday that closes the week of a date (Saturday and Sunday belong to the next one)."""
    return F.next_day(F.date_sub(date, 1), "FRI")


def last_friday(date="date"):
    return F.date_sub(F.next_day(date, "FRI"), 7)


def last_month_end(date="date"):
    return F.date_sub(F.trunc(F.date_add(date, 1), "MM"), 1)


def resample(frame: DataFrame, label, step: str, numbered: bool = False) -> DataFrame:
    """Last close, highest high, lowest low, summed volume per period.

    Periods without a bar between a ticker's first and last one appear with
    nulls (volume 0), because windows over periods count them.  ``numbered`` adds rn and n_rows.
    """
    made = (frame.groupBy("ticker", label.alias("date"))
            .agg(F.max_by("c", "date").alias("c"), F.max("h").alias("h"), F.min("l").alias("l"),
                 F.sum("vol").alias("vol")))
    span = made.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    if step == "week":
        days = F.sequence("a", "b", F.expr("interval 7 days"))
        number = lambda upto: (F.datediff(upto, "a") / 7 + 1).cast("bigint")
    else:
        days = F.transform(F.sequence(F.trunc("a", "MM"), F.col("b"), F.expr("interval 1 month")), F.last_day)
        number = lambda upto: ((F.year(upto) - F.year("a")) * 12 + F.month(upto) - F.month("a") + 1).cast("bigint")
    calendar = span.select("ticker", "a", number("b").alias("n_rows"), F.explode(days).alias("date"))
    return (calendar.select("ticker", "date", *([number("date").alias("rn"), "n_rows"] if numbered else []))
                    .join(made, ["ticker", "date"], "left").withColumn("vol", F.coalesce("vol", F.lit(0.0))))


def period_columns(numbered, label, visible, step, registry, names, size=BLOCK_ROWS) -> DataFrame:
    """ticker, rn and the named columns of the last finished period on each bar's date.

    Periods follow each other without gaps, so their numbers come from their dates.
    """
    sheet = Sheet(registry)
    outputs = {n: sheet.f(n) for n in sorted(names)}
    periods = written(resample(numbered.select("ticker", "date", "h", "l", "c", "vol"), label, step, True), step)
    periods = add_kernels(periods, {b for b in sheet.used_base if b.startswith("k_")}, size)
    made = run_sheet(periods, sheet, outputs, size=size).drop("rn").withColumnRenamed("date", "period")
    return numbered.select("ticker", "rn", visible.alias("period")).join(made, ["ticker", "period"], "left").drop("period")


def balance_volume(numbered: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """ticker, rn, obv: running sum of +-volume by the sign of the price change (first row -volume)."""
    frame = into_blocks(numbered.select("ticker", "rn", "n_rows", "c", "vol"), 1, size=size)
    in_block = W.partitionBy("ticker", "blk").orderBy("rn")
    move = F.col("c") - F.lag("c").over(in_block)
    signed = frame.withColumn("signed", F.when(move == 0, 0.0).when(move > 0, F.col("vol")).otherwise(-F.col("vol"))).where("own")
    sums = signed.groupBy("ticker", "blk").agg(F.sum("signed").alias("block_sum"))
    before = sums.select("ticker", "blk", (F.sum("block_sum").over(W.partitionBy("ticker").orderBy("blk")) - F.col("block_sum")).alias("before"))
    running = F.sum("signed").over(in_block.rowsBetween(W.unboundedPreceding, 0))
    return signed.withColumn("running", running).join(before, ["ticker", "blk"]).select("ticker", "rn", (F.col("before") + F.col("running")).alias("obv"))


def series_by_day(bars: DataFrame, series: DataFrame, on: list[str], name: str) -> DataFrame:
    """One row a calendar day (and key): the close of a series as of that day, up to the last bar."""
    days = spread_days(series, on, bars.agg(F.max("date").alias("last_day")))
    return days.select(*on, F.col("day").alias("date"), F.col("close").alias(name))


def add_series(frame: DataFrame, series: DataFrame, on: list[str], name: str) -> DataFrame:
    """Left join of a series spread over days: its close as of each bar date."""
    keys = [k for k in on if k != "day"]
    return frame.join(series_by_day(frame, series, keys, name), [*keys, "date"], "left")


def build_features(bars: DataFrame, names, feature_set: str = "v3", market: DataFrame | None = None,
                   sector_bars: DataFrame | None = None, sectors: DataFrame | None = None,
                   size: int = BLOCK_ROWS, prices: bool = False, issues: list | None = None) -> DataFrame:
    """ticker, date and the named features (doubles) for every bar, with the raw prices on request.

    With a list in ``issues``, a feature whose definition fails becomes an all-null
    column and is reported there as (name, error) instead of stopping the build.
    """
    registry = SETS[feature_set]
    sheet = new_sheet(registry, market is not None, sectors is not None)
    outputs = {n: defined(sheet, n, issues) for n in names}
    used = set(sheet.used_base)
    if used & {"run_vr", "run_gr"}:  # the regimes themselves are built on the same table
        regimes = new_sheet(registry, market is not None)
        for n in ("volatility_regime", "gain_regime"):
            regimes.f(n)
        used |= regimes.used_base
    base = daily_base(bars, used, market, sector_bars, sectors, size, exact=feature_set in ("v1", "v2"), prices=prices)
    if sheet.used_base & {"run_vr", "run_gr"}:
        base = add_regime_runs(base, sheet.used_base, market, size)
    keep = ("date", "o", "h", "l", "close", "volume") if prices else ("date",)
    made = run_sheet(base, sheet, outputs, keep=keep, size=size).drop("rn")
    return made.withColumnsRenamed({"o": "open", "h": "high", "l": "low"})


def defined(sheet: Sheet, name: str, issues: list | None):
    if issues is None:
        return sheet.f(name)
    try:
        return sheet.f(name)
    except Exception as error:
        issues.append((name, f"{type(error).__name__}: {error}"))
        return sheet.term(None)


def new_sheet(registry, has_market=True, has_sectors=True, **kw) -> Sheet:
    if not has_market:
        registry = {**registry, **{n: (lambda p, v=v: p.term(v)) for n, v in WITHOUT_MARKET.items() if n in registry}}
    return Sheet(registry, **kw)


def daily_base(bars, used, market=None, sector_bars=None, sectors=None, size=BLOCK_ROWS, exact=False, prices=False) -> DataFrame:
    """Numbered bars plus whatever the features read besides prices.

    ``exact`` joins the market on equal dates and fills forward over the
    ticker's own rows (sets v1 and v2) instead of as of each date (v3).
    """
    frame = number_rows(price_columns(bars, prices))
    kernel_names, weekly, monthly = ({b for b in used if b.startswith(kind)} for kind in ("k_", "wk_", "mo_"))
    by_row, runs = {}, used & {"run_vr", "run_gr"}
    if kernel_names or weekly or monthly or runs or "obv" in used or (exact and "m" in used and market is not None):
        frame = written(frame, "numbered")  # read by each of the following
    if kernel_names:
        by_row["kernels"] = lambda: kernels(frame, kernel_names, size).drop("blk")
    if weekly:
        by_row["weekly"] = lambda: period_columns(frame, week_label(), last_friday(), "week", WEEKLY, weekly, size)
    if monthly:
        by_row["monthly"] = lambda: period_columns(frame, F.last_day("date"), last_month_end(), "month", MONTHLY, monthly, size)
    if "obv" in used:
        by_row["obv"] = lambda: balance_volume(frame, size)
    wants_market = ("m" in used or "s" in used) and market is not None
    if wants_market and exact:
        by_row["market"] = lambda: fill_forward(
            frame.select("ticker", "rn", "n_rows", "date").join(market.select("date", F.col("close").alias("m")), "date", "left"), "m", size).select("ticker", "rn", "m")
    out = frame
    for side in all_written(by_row):  # narrow tables of one row a bar; the price table is dealt out once for all of them
        out = out.join(side, ["ticker", "rn"], "left")
    if wants_market and not exact:
        out = out.join(series_by_day(bars, market.drop("ticker"), [], "m"), "date", "left")
    if "s" in used:
        if sectors is None:
            out = out.withColumn("s", F.col("m") if market is not None else F.lit(None).cast("double"))
        else:
            series = sector_bars.withColumnRenamed("ticker", "symbol")
            known = series.select("symbol").distinct().withColumn("known", F.lit(True))
            out = (out.join(sector_symbols(bars, sectors).join(known, "symbol", "left"), "ticker", "left")
                      .join(series_by_day(bars, series, ["symbol"], "s"), ["symbol", "date"], "left"))
            fallback = F.col("m") if market is not None else F.lit(None).cast("double")
            out = out.withColumn("s", F.when(F.col("known"), F.col("s")).otherwise(fallback)).drop("symbol", "known")
    return written(out, "base") if runs else out


def all_written(tables: dict) -> list[DataFrame]:
    """Tables that do not depend on each other, stored at the same time so that short jobs overlap."""
    if not tables:
        return []
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPool(len(tables)) as pool:
        return [job.get() for job in [pool.apply_async(own(lambda n=n, t=t: written(t(), n))) for n, t in tables.items()]]


def add_regime_runs(base, used, market, size):
    """Lengths of the current volatility and gain regimes (columns run_vr, run_gr).

    Runs may reach back over any number of blocks, so the two regime series are
    written once and then scanned block by block.
    """
    outputs, sheet = {}, new_sheet(V3, market is not None)
    if "run_vr" in used:
        outputs["vr"] = sheet.f("volatility_regime")
    if "run_gr" in used:
        outputs["gr"] = sheet.f("gain_regime")
    regimes = written(run_sheet(base, sheet, outputs, keep=("n_rows",), size=size), "regimes")
    if "run_vr" in used:
        regimes = add_jump_runs(regimes, "vr", 0.1, "run_vr", size)
    if "run_gr" in used:
        regimes = add_anchored_runs(regimes, "gr", 0.2, "run_gr", size)
    runs = regimes.select("ticker", "rn", *[c for c in ("run_vr", "run_gr") if c in used])
    return base.join(runs, ["ticker", "rn"])
