"""Reports on trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.operators.filters import passes, passes_all, usable
from dailybars.plans.blocks import into_blocks
from dailybars.plans.ordered import exact_quantiles, masked_paths, with_totals

EXIT_ORDER = ["exit_date", "ticker", "entry_date"]


def share(a, b, scale=1.0):
    return F.coalesce(F.try_divide(a * F.lit(scale), b), F.lit(0.0))


def equity_path(trades: DataFrame, group=()) -> DataFrame:
    """Cumulative pnl, its running peak and the drawdown after each trade, by exit date."""
    path = with_totals(trades, EXIT_ORDER, group, sums=[("equity", "pnl")], highs=[("peak", "equity")])
    return path.withColumn("drawdown", F.col("peak") - F.col("equity"))


def concurrent_positions(trades: DataFrame, group=()) -> DataFrame:
    """Largest number of open positions; a day's events keep trade order, entry before exit."""
    event = lambda day, step, kind: F.struct(F.col(day).alias("at"), F.lit(step).alias("step"), F.lit(kind).alias("kind"))
    events = trades.select(*group, "ticker", "entry_date", F.explode(F.array(
        event("entry_date", 1.0, 0), event("exit_date", -1.0, 1))).alias("e")).select(*group, "ticker", "entry_date", "e.*")
    path = with_totals(events, ["at", "ticker", "entry_date", "kind"], group, sums=[("open_now", "step")])
    most = F.max("open_now").cast("bigint").alias("max_concurrent_positions")
    return path.groupBy(*group).agg(most) if group else path.agg(most)


def trade_metrics(trades: DataFrame, position_size: float = 1000.0, group=()) -> DataFrame:
    """One row of metrics per group: counts, returns, drawdown, Sharpe, capital, annual return."""
    r, pnl, days = F.col("return"), F.col("pnl"), F.col("holding_days")
    basic = [
        F.count(F.lit(1)).alias("n_trades"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(r).alias("avg_return"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("avg_pnl"),
        F.stddev_samp(r).alias("sd"), F.avg(days).alias("avg_holding_days"),
        F.sum(F.when(pnl > 0, pnl)).alias("won"), F.sum(F.when(pnl < 0, -pnl)).alias("lost"),
        F.min("entry_date").alias("first_entry"), F.max("exit_date").alias("last_exit")]
    worst = F.max("drawdown").alias("max_drawdown")
    path, base = equity_path(trades, group), trades
    if group:
        m = (base.groupBy(*group).agg(*basic).join(path.groupBy(*group).agg(worst), list(group))
             .join(concurrent_positions(trades, group), list(group)))
    else:
        m = base.agg(*basic).crossJoin(path.agg(worst)).crossJoin(concurrent_positions(trades))
    sharpe = F.when((F.col("sd") > 0) & (F.col("avg_holding_days") > 0),
                    F.col("avg_return") / F.col("sd") * F.sqrt(F.try_divide(F.lit(252.0), F.col("avg_holding_days")))).otherwise(0.0)
    capital = F.col("max_concurrent_positions") * F.lit(position_size)
    span = F.datediff("last_exit", "first_entry")
    stake = F.when(capital > 0, capital).otherwise(F.lit(position_size))
    grown = 1 + F.col("total_pnl") / stake
    annual = F.when(span > 0, F.pow(grown, F.try_divide(F.lit(365.0), span)) - 1).otherwise(0.0)
    return m.select(
        *group, "n_trades", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("win_rate", "avg_return", "total_pnl", "avg_pnl", "max_drawdown")], sharpe.alias("sharpe_ratio"), F.try_divide(F.coalesce("won", F.lit(0.0)), F.col("lost")).alias("profit_factor"),
        F.coalesce("avg_holding_days", F.lit(0.0)).alias("avg_holding_days"), annual.alias("annual_return"),
        F.concat_ws(" to ", F.date_format("first_entry", "yyyy-MM-dd"), F.date_format("last_exit", "yyyy-MM-dd")).alias("date_range"),
        F.coalesce("max_concurrent_positions", F.lit(0)).alias("max_concurrent_positions"), F.coalesce(capital, F.lit(0.0)).alias("max_capital_invested"))


def simple_metrics(trades: DataFrame) -> DataFrame:
    """Number, hit rate, mean return, total and mean pnl, largest drawdown (by entry)."""
    path = with_totals(trades, ["entry_date", "ticker"], sums=[("equity", "pnl")], highs=[("peak", "equity")])
    return path.agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("return") > 0).cast("double")).alias("hit_rate"),
        F.avg("return").alias("avg_return"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"),
        F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))


def exit_reasons(trades: DataFrame) -> DataFrame:
    n = trades.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("trades"))
    return n.withColumn("share", F.col("trades") / F.sum("trades").over(W.partitionBy(F.lit(0))))


def bucketed(df: DataFrame, column: str, buckets, lower_open: bool) -> DataFrame:
    """Counts and shares of non-empty buckets given as (low, high, label)."""
    c, label = F.col(column), F.lit(None).cast("string")
    for lo, hi, name in reversed(buckets):
        low = F.lit(True) if lo is None else (c > lo if lower_open else c >= lo)
        high = F.lit(True) if hi is None else (c <= hi if lower_open else c < hi)
        label = F.when(low & high, name).otherwise(label)
    n = df.where(c.isNotNull()).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("trades"))
    total = F.sum("trades").over(W.partitionBy(F.lit(0)))
    return n.withColumn("pct", F.col("trades") / total * 100).where("bucket is not null")


# Return ranges of the time-limit breakdown.
RETURN_BUCKETS = [(None, -0.10, "< -10%"), (-0.10, -0.05, "-10% to -5%"), (-0.05, 0.0, "-5% to 0%"), (0.0, 0.05, "0% to 5%"),
                  (0.05, 0.10, "5% to 10%"), (0.10, 0.15, "10% to 15%"), (0.15, None, "> 15%")]
# Stop distance ranges.
STOP_BUCKETS = [(0.0, 0.04, "0-4%"), (0.04, 0.05, "4-5%"), (0.05, 0.07, "5-7%"), (0.07, 0.10, "7-10%"), (0.10, None, ">10%")]
# Holding-day bins.
DAY_BINS = [0, 1, 2, 3, 5, 7, 10, 15, 30]


def time_limit_summary(trades: DataFrame) -> DataFrame:
    """Wins, losses and return statistics (percent) of trades that ran out of time."""
    t = trades.where("exit_reason = 'time_limit'").withColumn("pct", F.col("return") * 100)
    side = F.when(F.col("pct") > 0, "won").when(F.col("pct") < 0, "lost")
    t = t.withColumn("side", side)
    part = lambda s, fn: fn(F.when(F.col("side") == s, F.col("pct")))
    flat = t.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("side") == "won", 1)).alias("wins"),
        F.count(F.when(F.col("side") == "lost", 1)).alias("losses"), F.count(F.when(F.col("pct") == 0, 1)).alias("breakeven"),
        F.avg("pct").alias("avg_return"),
        *[part(s, fn).alias(f"{n}_{s}") for s in ("won", "lost") for n, fn in (("avg", F.avg), ("max", F.max), ("min", F.min))])
    middle = exact_quantiles(t, "pct", {"median_return": 0.5}, unique=("ticker", "entry_date"))
    by_side = exact_quantiles(t.where("side is not null"), "pct", {"m": 0.5}, ("side",), ("ticker", "entry_date"))
    sides = by_side.agg(*[F.max(F.when(F.col("side") == s, F.col("m"))).alias(f"median_{s}") for s in ("won", "lost")])
    return flat.crossJoin(middle).crossJoin(sides)


def stop_summary(trades: DataFrame) -> DataFrame:
    """Stop distances used and, where the swing mode recorded them, how they were found."""
    s = F.col("stop_loss_pct")
    made = [F.avg(s).alias("avg_stop_pct"), F.min(s).alias("min_stop_pct"), F.max(s).alias("max_stop_pct")]
    if "used_swing_low" in trades.columns:
        used = F.coalesce("used_swing_low", F.lit(False))
        d, b = F.when(used, F.col("swing_distance_pct")), F.when(used, F.col("buffer_pct"))
        made += [F.count(F.when(used, 1)).alias("trades_using_swing_low"), F.count(F.when(~used, 1)).alias("trades_using_fallback"),
                 (F.avg(used.cast("double")) * 100).alias("swing_low_usage_pct"), F.avg(d).alias("avg_swing_distance_pct"),
                 F.min(d).alias("min_swing_distance_pct"), F.max(d).alias("max_swing_distance_pct"), F.avg(b).alias("avg_buffer_pct")]
    return trades.agg(*made)


def compare_groups(trades: DataFrame, features, first, second, least_effect: float = 0.0) -> DataFrame:
    """Mean of each feature in two groups of trades, with Cohen's d over the pooled deviation.

    One pass over the wide table; the single result row is then turned into one
    row per feature.
    """
    made = []
    for i, f in enumerate(features):
        for side, cond in (("a", first), ("b", second)):
            made += [F.avg(F.when(cond, F.col(f))).alias(f"m{side}{i}"), F.stddev_samp(F.when(cond, F.col(f))).alias(f"s{side}{i}")]
    wide = trades.agg(*made)
    rows = F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"ma{i}").alias("mean_a"), F.col(f"mb{i}").alias("mean_b"),
        F.col(f"sa{i}").alias("sd_a"), F.col(f"sb{i}").alias("sd_b")) for i, f in enumerate(features)]))
    t = wide.select(rows.alias("x")).select("x.*").where("sd_a > 0")
    pooled = F.sqrt((F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b")) / 2)
    d = F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled)
    return (t.withColumn("difference", F.col("mean_a") - F.col("mean_b")).withColumn("cohens_d", d)
            .withColumn("abs_effect", F.abs("cohens_d")).where(F.col("abs_effect") >= least_effect).drop("sd_a", "sd_b"))


def is_stop():
    return F.col("exit_reason") == "stop_loss"


def is_win():
    return F.col("return") > 0


def stop_vs_winner(trades: DataFrame, features) -> DataFrame:
    """Features that differ between stopped and winning trades, strongest first, with a filter text above 0.3."""
    t = compare_groups(trades, features, is_stop(), is_win())
    above = F.col("mean_a") > F.col("mean_b")
    text = F.when(F.col("abs_effect") > 0.3, F.concat(
        F.lit("Filter: "), F.col("feature"), F.when(above, " < ").otherwise(" > "), F.format_string("%.3f", "mean_a")))
    return t.select("feature", F.col("mean_a").alias("stop_loss_mean"), F.col("mean_b").alias("winner_mean"),
                    "difference", "cohens_d", "abs_effect", text.alias("recommendation"))


def filter_suggestions(trades: DataFrame, features, first, least_effect: float) -> DataFrame:
    """Operator and threshold (30% of the way from the lower mean) per differing feature."""
    winners = (F.col("exit_reason") != "stop_loss") & is_win()
    t = compare_groups(trades, features, first, winners, least_effect)
    a, b, e = F.col("mean_a"), F.col("mean_b"), F.col("abs_effect")
    return t.select(
        "feature", F.when(a > b, "<").otherwise(">").alias("operator"),
        (F.least(a, b) + F.abs(a - b) * 0.3).alias("value"), e.alias("effect_size"), "cohens_d",
        F.when(e > 0.5, "strong").when(e >= 0.3, "moderate").otherwise("weak").alias("category"))


def stop_analysis(trades: DataFrame, features, least_effect: float = 0.3) -> DataFrame:
    return filter_suggestions(trades, features, is_stop(), least_effect)


def immediate_stop_analysis(trades: DataFrame, features) -> DataFrame:
    return filter_suggestions(trades, features, F.col("holding_days") <= 1, 0.2)


def stop_counts(trades: DataFrame) -> DataFrame:
    """Counts and rates of stopped, winning, target and immediately stopped trades."""
    n = lambda c: F.count(F.when(c, 1))
    now = is_stop() & (F.col("holding_days") <= 1)
    return trades.agg(
        F.count(F.lit(1)).alias("total_trades"), n(is_stop()).alias("stop_loss_count"), n(is_win()).alias("winning_count"),
        n(F.col("exit_reason") == "target_reached").alias("target_count"),
        share(n(is_stop()), F.count(F.lit(1))).alias("stop_loss_rate"), n(now).alias("immediate_stop_count"),
        share(n(now), n(is_stop())).alias("immediate_stop_rate"))


def timing_histogram(trades: DataFrame) -> DataFrame:
    """Stopped trades by weekday (Monday 0) and by month."""
    t = trades.where(is_stop()).select(F.explode(F.array(
        F.struct(F.lit("weekday").alias("part"), F.weekday("entry_date").alias("value")),
        F.struct(F.lit("month").alias("part"), F.month("entry_date").alias("value")))).alias("x")).select("x.*")
    n = t.groupBy("part", "value").agg(F.count(F.lit(1)).alias("trades"))
    return n.withColumn("pct", F.col("trades") / F.sum("trades").over(W.partitionBy("part")) * 100)


def holding_statistics(trades: DataFrame) -> DataFrame:
    """Days until the stop: mean, median, range and the share stopped within a day."""
    t = trades.where(is_stop())
    d = F.col("holding_days")
    flat = t.agg(F.avg(d).alias("mean_days"), F.min(d).alias("min_days"), F.max(d).alias("max_days"),
                 F.count(F.when(d <= 1, 1)).alias("immediate"), (F.avg((d <= 1).cast("double")) * 100).alias("immediate_pct"))
    return flat.crossJoin(exact_quantiles(t, "holding_days", {"median_days": 0.5}, unique=("ticker", "entry_date")))


def holding_bins(trades: DataFrame) -> DataFrame:
    bins = [(a, b, f"{a}-{b} days") for a, b in zip(DAY_BINS, DAY_BINS[1:])]
    return bucketed(trades.where(is_stop()), "holding_days", bins, lower_open=False)


def return_statistics(trades: DataFrame) -> DataFrame:
    """Percent returns of stopped trades and the share that lost 7 to 8 percent."""
    t = trades.where(is_stop()).withColumn("pct", F.col("return") * 100)
    p = F.col("pct")
    near = (p <= -7.0) & (p >= -8.0)
    flat = t.agg(F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"), F.stddev_samp(p).alias("std"),
                 F.count(F.when(near, 1)).alias("near_threshold"), (F.avg(near.cast("double")) * 100).alias("near_pct"))
    return flat.crossJoin(exact_quantiles(t, "pct", {"median": 0.5}, unique=("ticker", "entry_date")))


def filter_impact(trades: DataFrame, filters) -> DataFrame:
    """Stops and winners a set of filters would exclude; warnings at 50% of trades, 20% of winners."""
    ok = passes_all(trades.columns, filters)
    n = lambda c: F.count(F.when(c, 1))
    out, total = n(~ok), F.count(F.lit(1))
    m = trades.agg(
        share(n(is_stop() & ~ok), n(is_stop()), 100).alias("stop_loss_excluded_pct"),
        share(n(is_win() & ~ok), n(is_win()), 100).alias("winner_excluded_pct"),
        share(n(is_stop() & ok), n(ok), 100).alias("estimated_new_sl_rate"), n(ok).alias("estimated_total_trades"),
        total.alias("total_trades_before"), n(is_stop()).alias("stop_loss_count_before"),
        n(is_stop() & ok).alias("stop_loss_count_after"), share(out, total, 100).alias("excluded_pct"))
    warn = F.concat_ws("; ", F.when(F.col("excluded_pct") >= 50, "few trades left"),
                       F.when(F.col("winner_excluded_pct") >= 20, "many winners excluded"),
                       F.when(F.col("estimated_total_trades") == 0, "no trades left"))
    return m.withColumn("warnings", warn).drop("excluded_pct")


def big_loss():
    """A stop by reason, or a loss of more than 5 percent."""
    return F.coalesce(F.lower("exit_reason").contains("stop_loss"), F.lit(False)) | (F.col("return") < -0.05)


def impact_per_filter(trades: DataFrame, filters) -> DataFrame:
    """Exclusions of each filter alone and of all together, in one pass."""
    filters = usable(trades.columns, filters)
    flags = {f[0]: ~passes(f) for f in filters} | {"combined": ~passes_all(trades.columns, filters)}
    n = lambda c: F.count(F.when(c, 1))
    wide = trades.agg(F.count(F.lit(1)).alias("n"), n(is_win()).alias("w"), n(big_loss()).alias("s"), *[
        expr for i, out in enumerate(flags.values())
        for expr in (n(out).alias(f"n{i}"), n(out & is_win()).alias(f"w{i}"), n(out & big_loss()).alias(f"s{i}"))])
    row = lambda i, name: F.struct(
        F.lit(name).alias("filter"), F.col(f"w{i}").alias("winners_excluded"), share(F.col(f"w{i}"), F.col("w"), 100).alias("winners_excluded_pct"),
        F.col(f"s{i}").alias("stop_losses_excluded"), share(F.col(f"s{i}"), F.col("s"), 100).alias("stop_losses_excluded_pct"),
        F.col(f"n{i}").alias("total_excluded"), share(F.col(f"n{i}"), F.col("n"), 100).alias("total_excluded_pct"))
    return wide.select(F.explode(F.array(*[row(i, name) for i, name in enumerate(flags)])).alias("x")).select("x.*")


def filter_metrics(trades: DataFrame, filters, position_size: float = 1000.0) -> DataFrame:
    """Trade metrics before filtering, behind each filter alone and behind all of them, with what remains of the trades.

    Every trade carries one flag a filter; counts are one aggregate, drawdown and open positions one ordered scan each
    for all filters together (``masked_paths``).
    """
    filters = usable(trades.columns, filters)
    masks = {"before": F.lit(True)} | {f[0]: passes(f) for f in filters} | {"combined": passes_all(trades.columns, filters)}
    flagged = trades.withColumns({f"f{i}": F.coalesce(m, F.lit(False)) for i, m in enumerate(masks.values())})
    flags = {n: F.col(f"f{i}") for i, n in enumerate(masks)}
    r, pnl = F.col("return"), F.col("pnl")

    def basics(name, on):
        kept = lambda c: F.when(on, c)
        return F.struct(
            F.lit(name).alias("filter"), F.count(kept(1)).alias("remaining_trades"), F.count(F.lit(1)).alias("all"), F.avg(kept((r > 0).cast("double"))).alias("win_rate"),
            F.avg(kept(r)).alias("avg_return"), F.sum(kept(pnl)).alias("total_pnl"), F.stddev_samp(kept(r)).alias("sd"), F.avg(kept(F.col("holding_days"))).alias("avg_holding_days"),
            F.sum(F.when(on & (pnl > 0), pnl)).alias("won"), F.sum(F.when(on & (pnl < 0), -pnl)).alias("lost"),
            F.min(kept(F.col("entry_date"))).alias("first_entry"), F.max(kept(F.col("exit_date"))).alias("last_exit"))

    m = flagged.agg(F.array(*[basics(n, f) for n, f in flags.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    falls = masked_paths(flagged, EXIT_ORDER, F.col("pnl"), flags).select(F.col("mask").alias("filter"), F.col("deepest_fall").alias("max_drawdown"))
    event = lambda day, step, kind: F.struct(F.col(day).alias("at"), F.lit(step).alias("step"), F.lit(kind).alias("kind"))
    events = flagged.select("ticker", "entry_date", *[f"f{i}" for i in range(len(flags))], F.explode(F.array(event("entry_date", 1.0, 0), event("exit_date", -1.0, 1))).alias("e")).select("*", "e.*")
    open_ = masked_paths(events, ["at", "ticker", "entry_date", "kind"], F.col("step"), flags).select(F.col("mask").alias("filter"), F.col("peak").alias("open_most"))
    m = m.join(falls, "filter", "left").join(open_, "filter", "left")
    days, span = F.col("avg_holding_days"), F.datediff("last_exit", "first_entry")
    sharpe = F.when((F.col("sd") > 0) & (days > 0), F.col("avg_return") / F.col("sd") * F.sqrt(F.try_divide(F.lit(252.0), days))).otherwise(0.0)
    stake = F.when(F.col("open_most") > 0, F.col("open_most") * position_size).otherwise(F.lit(position_size))
    annual = F.when(span > 0, F.pow(1 + F.col("total_pnl") / stake, F.try_divide(F.lit(365.0), span)) - 1).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return m.select("filter", "remaining_trades", share(F.col("remaining_trades"), F.col("all"), 100).alias("remaining_pct"),
                    *map(zero, ("win_rate", "avg_return", "total_pnl", "max_drawdown")), sharpe.alias("sharpe_ratio"),
                    F.try_divide(F.coalesce("won", F.lit(0.0)), F.col("lost")).alias("profit_factor"), annual.alias("annual_return"))


COMPARED = ["n_trades", "win_rate", "avg_return", "total_pnl", "max_drawdown", "sharpe_ratio", "profit_factor"]


def side_by_side(runs: DataFrame, run: str, base: str, other: str, position_size: float = 1000.0) -> DataFrame:
    """Seven metrics of two runs of the same backtest, one row per metric."""
    m = trade_metrics(runs, position_size, (run,))
    long = m.select(run, F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in COMPARED])).alias("x")).select(run, "x.*")
    pick = lambda name: F.max(F.when(F.col(run) == name, F.col("value")))
    return (long.groupBy("metric").agg(pick(base).alias("baseline"), pick(other).alias("filtered"))
            .withColumn("change", F.col("filtered") - F.col("baseline")))


def preset_comparison(trades: DataFrame, presets: dict) -> DataFrame:
    """Impact of several presets (a handful of filter lists) and which is best per column."""
    n = lambda c: F.count(F.when(c, 1))

    def impact(name, filters):
        kept = passes_all(trades.columns, filters)
        return F.struct(
            F.lit(name).alias("preset"), n(kept).alias("remaining_trades"),
            share(n(~kept & is_win()), n(is_win()), 100).alias("winners_excluded_pct"),
            share(n(~kept & big_loss()), n(big_loss()), 100).alias("stop_losses_excluded_pct"),
            share(n(kept & is_win()), n(kept)).alias("win_rate"))

    t = trades.agg(F.array(*[impact(*p) for p in presets.items()]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    over = W.partitionBy(F.lit(0))
    best = lambda c, fn: F.col(c) == fn(c).over(over)
    return t.select("*", best("winners_excluded_pct", F.min).alias("best_winners"),
                    best("stop_losses_excluded_pct", F.max).alias("best_stops"), best("win_rate", F.max).alias("best_win_rate"))


def compare_runs(runs: DataFrame, run: str = "run_id", least_win_rate: float = 0.0, position_size: float = 1000.0) -> DataFrame:
    return trade_metrics(runs, position_size, (run,)).where(F.col("win_rate") >= least_win_rate)


def every_day(points: DataFrame) -> DataFrame:
    """Values at dates carried over every calendar day (dates are few, trades are not)."""
    order = W.partitionBy(F.lit(0)).orderBy("date")
    stretched = points.withColumn("upto", F.coalesce(F.date_sub(F.lead("date").over(order), 1), F.col("date")))
    return stretched.withColumn("date", F.explode(F.sequence("date", "upto"))).drop("upto")


def equity_curve(trades: DataFrame, start_value: float = 10000.0) -> DataFrame:
    """Product of (1 + return) per exit date, compounded, on a daily calendar."""
    by_day = trades.groupBy(F.col("exit_date").alias("date")).agg(F.product(1 + F.col("return")).alias("factor"))
    so_far = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    curve = by_day.withColumn("equity", F.lit(start_value) * F.product("factor").over(so_far))
    return every_day(curve.select("date", "equity"))


def drawdown_curve(trades: DataFrame) -> DataFrame:
    """Drawdown after the last trade of each exit date, on a daily calendar."""
    last = equity_path(trades).groupBy(F.col("exit_date").alias("date")).agg(
        F.max_by("equity", "pos").alias("equity"), F.max_by("drawdown", "pos").alias("drawdown"))
    return every_day(last)


def rolling_trade_metrics(trades: DataFrame, window: int = 20, size: int = 65536) -> DataFrame:
    """Sharpe (x sqrt 252) and win rate over the last ``window`` trades by exit date."""
    placed = with_totals(trades.select("ticker", "entry_date", "exit_date", "return"), EXIT_ORDER).withColumnRenamed("pos", "rn")
    frame = into_blocks(placed, window - 1, size=size)
    w = W.partitionBy("blk").orderBy("rn").rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp("return").over(w)
    sharpe = F.when(sd > 0, F.avg("return").over(w) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0)
    wins = F.avg((F.col("return") > 0).cast("double")).over(w) * 100
    return (frame.withColumn("rolling_sharpe", sharpe).withColumn("rolling_win_rate", wins).where("own")
            .select("ticker", "entry_date", "exit_date", "rolling_sharpe", "rolling_win_rate"))


def return_histogram(trades: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins of percent returns, the last one closed."""
    t = trades.select((F.col("return") * 100).alias("pct"))
    edge = t.agg(F.min("pct").alias("lo"), F.max("pct").alias("hi"))
    t = t.crossJoin(F.broadcast(edge))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("pct") - F.col("lo"), width)), F.lit(0)))
    return t.groupBy(bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("trades"))
