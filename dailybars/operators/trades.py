"""Trade simulation: signals to trades with stops, targets and a time limit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.operators.filters import date_slice, passes_all
from dailybars.operators.stops import StopConfig, stop_columns, stop_config
from dailybars.plans.blocks import BLOCK_ROWS, into_blocks, number_rows
from dailybars.plans.cut import written
from dailybars.plans.first_exit import FirstExit

TRADE_FIELDS = ["ticker", "entry_date", "entry_price", "exit_date", "exit_price", "return", "pnl", "holding_days", "exit_reason"]
STOP_FIELDS = ["stop_loss_pct", "used_swing_low", "swing_distance_pct", "buffer_pct"]


def candidate_exits(bars: DataFrame, signal: str, horizon: int, position_size: float = 1000.0,
                    return_threshold: float | None = None, stops: StopConfig | None = None,
                    entry_lag: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Where a trade entered at each signal row would leave, had it been free to enter.

    Entry is at the open of the signal row (``entry_lag=1``: of the next row).
    On each later row the stop is looked at first (an open below it fills at the
    open, a low or close below it at the stop), then the close against the
    target; on the horizon row the open is used instead.  Without enough rows
    the trade ends at the ticker's last close.  Only signal rows are searched from (``FirstExit``).
    """
    numbered = bars if "rn" in bars.columns else number_rows(bars)
    stop = stop_columns(stops, numbered.columns, "entry_price") if stops else {}
    read = [c for c in numbered.columns if c in ("ticker", "date", "rn", "n_rows", "open", "low", "close", signal)]
    read += [c for c in _signal_columns(numbered, signal) if c not in read and (c.lower() == "atr14_normalized" or c.lower().startswith("swing_low_"))]
    frame = into_blocks(numbered.select(*read), entry_lag, horizon, size)
    if entry_lag:
        order = W.partitionBy("ticker", "blk").orderBy("rn")
        frame = frame.withColumns({c: F.lag(c, entry_lag).over(order) for c in _signal_columns(numbered, signal) if c in read})
    frame = frame.withColumn("entry_price", F.col("open")).withColumns(stop)
    narrow = frame.select("ticker", "blk", "rn", "date", "open", "low", "close", (F.col("own") & F.coalesce(F.col(signal), F.lit(False))).alias("enters"), *stop)

    names, stopped = list(stop), stops is not None

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        entry = np.flatnonzero(pdf["enters"].to_numpy())
        price = {c: pdf[c].to_numpy(float) for c in ("open", "low", "close")}
        at = price["open"][entry]
        floor = at * (1 - pdf["stop_loss_pct"].to_numpy(float)[entry]) if stopped else np.full(len(entry), np.nan)
        target = np.nan if return_threshold is None else return_threshold
        with np.errstate(invalid="ignore", divide="ignore"):
            leaves = lambda low, high, i: (low < floor[i]) | (high / at[i] - 1 >= target)
            lowest = np.fmin(np.fmin(price["open"], price["low"]), price["close"])
            end = np.minimum(entry + horizon, len(pdf))  # the horizon row is an exit by itself
            x = FirstExit(lowest, price["close"], horizon).find(entry + 1, np.maximum(end, entry + 1), leaves)
            out_of_rows = x >= len(pdf)
            x = np.minimum(x, len(pdf) - 1)
            hit = ~out_of_rows & (lowest[x] < floor)
            last = ~out_of_rows & (x == entry + horizon)
            reached = price["open"][x] / at - 1 >= target
        reason = np.select([out_of_rows, hit, last & reached, last], ["end_of_data", "stop_loss", "target_reached", "time_limit"], "target_reached")
        paid = np.select([out_of_rows, hit & (price["open"][x] < floor), hit, last], [price["close"][x], price["open"][x], floor, price["open"][x]], price["close"][x])
        made = pdf.loc[entry, ["ticker", "rn", "date", *names]].reset_index(drop=True)
        return made.assign(entry_price=at, exit_price=paid, exit_reason=reason, exit_rn=pdf["rn"].to_numpy()[x], exit_date=pdf["date"].to_numpy()[x])

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join([f"ticker {kinds['ticker']}, rn bigint, date {kinds['date']}", *(f"{c} {kinds[c]}" for c in stop),
                        f"entry_price double, exit_price double, exit_reason string, exit_rn bigint, exit_date {kinds['date']}"])
    found = narrow.groupBy("ticker", "blk").applyInPandas(exits, schema)
    null_if_nan = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("entry_price", "exit_price")}
    gain = F.col("exit_price") / F.col("entry_price") - 1
    out = found.withColumns(null_if_nan).where("exit_price is not null").withColumnRenamed("date", "entry_date").withColumns({
        "return": gain, "pnl": gain * position_size, "holding_days": F.datediff("exit_date", "entry_date")})
    return out.select(*TRADE_FIELDS, *stop, "rn", "exit_rn")


def _signal_columns(numbered, signal):
    return [c for c in numbered.columns if c not in ("ticker", "date", "rn", "n_rows", "open", "high", "low", "close", "volume")]


def _chain_end(rn, exit_rn):
    """For every candidate of a block, the first free row after the trades it leads to inside the block."""
    following = np.searchsorted(rn, exit_rn, side="right")
    end = np.empty(len(rn), dtype="int64")
    for i in range(len(rn) - 1, -1, -1):
        end[i] = exit_rn[i] + 1 if following[i] == len(rn) else end[following[i]]
    return end


def non_overlapping(candidates: DataFrame, horizon: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Per ticker: take the first candidate, skip those up to its exit, repeat.

    A trade lasts at most ``horizon`` rows, so a block of rows can only be
    entered with its first ``horizon`` rows taken.  Each block reports where every
    such entry leads (at most horizon + 2 rows), the reports of a ticker are
    chained, and the blocks are then walked in parallel from their known start.
    """
    candidates = written(candidates, "candidates")  # read for the reports and again for the walk
    blocks = candidates.withColumn("blk", F.floor((F.col("rn") - 1) / F.lit(size)))

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, end = pdf["rn"].to_numpy(), _chain_end(pdf["rn"].to_numpy(), pdf["exit_rn"].to_numpy())
        blk = int(pdf["blk"].iloc[0])
        keep = int(np.searchsorted(rn, blk * size + horizon + 1, side="right")) + 1
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "blk": [blk],
                             "entries": [rn[:keep].tolist()], "ends": [end[:keep].tolist()]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = 1, []
        for row in pdf.sort_values("blk").itertuples():
            out.append((row.ticker, row.blk, free))
            i = int(np.searchsorted(row.entries, free))
            free = int(row.ends[i]) if i < len(row.entries) else free
        return pd.DataFrame(out, columns=["ticker", "blk", "free"])

    columns = candidates.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, exit_rn = pdf["rn"].to_numpy(), pdf["exit_rn"].to_numpy()
        i, taken = int(np.searchsorted(rn, pdf["free"].iloc[0])), []
        while i < len(rn):
            taken.append(i)
            i = int(np.searchsorted(rn, exit_rn[i], side="right"))
        return pdf.iloc[taken][columns]

    reports = blocks.select("ticker", "blk", "rn", "exit_rn").groupBy("ticker", "blk").applyInPandas(
        report, "ticker string, blk bigint, entries array<bigint>, ends array<bigint>")
    starts = reports.groupBy("ticker").applyInPandas(chain, "ticker string, blk bigint, free bigint")
    return blocks.join(starts, ["ticker", "blk"]).groupBy("ticker", "blk").applyInPandas(walk, fields)


def backtest(bars: DataFrame, signal: str, horizon: int, position_size: float = 1000.0,
             return_threshold: float | None = None, stops: StopConfig | None = None,
             entry_lag: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Trades of a boolean entry signal, one position per ticker at a time."""
    found = candidate_exits(bars, signal, horizon, position_size, return_threshold, stops, entry_lag, size)
    return non_overlapping(found, horizon + entry_lag, size).drop("rn", "exit_rn")


def oracle_signal(horizon: int):
    return F.col(f"label_{horizon}d") == 1


def rsi_signal(column: str = "rsi"):
    return F.col(column) < 30


def run_backtest(features: DataFrame, signal, horizon: int, position_size: float = 1000.0,
                 return_threshold: float | None = None, stops: StopConfig | None = None, filters=(),
                 start=None, end=None, **kw) -> DataFrame:
    """Slice, signal, entry filters and stops for all tickers at once.

    Without a stop configuration the stop is half the target, if there is one.
    """
    data = date_slice(features.drop("rn", "n_rows"), start, end)
    data = data.withColumn("entry_signal", F.coalesce(signal, F.lit(False)) & passes_all(data.columns, filters))
    if stops is None and return_threshold is not None:
        stops = stop_config(return_threshold=return_threshold)
    return backtest(data, "entry_signal", horizon, position_size, return_threshold, stops, **kw)
