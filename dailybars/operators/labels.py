"""Forward labels and fixed-horizon trades, per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.plans.blocks import BLOCK_ROWS, into_blocks, number_rows


def forward(bars: DataFrame, h: int, size: int = BLOCK_ROWS):
    """Numbered bars in blocks with ``h`` rows of look-ahead, and their window."""
    frame = into_blocks(bars if "rn" in bars.columns else number_rows(bars), 0, h, size)
    return frame, W.partitionBy("ticker", "blk").orderBy("rn")


def _own(frame):
    return frame.where("own").drop("own", "blk", "n_rows", "rn")


def label_future_return(bars: DataFrame, h: int, threshold: float, name: str | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """1 if the best high of the next h rows is more than ``threshold`` above the close.

    The last rows of a ticker use what future there is (none: 0) and never look
    into another ticker.
    """
    frame, w = forward(bars, h, size)
    best = F.max("high").over(w.rowsBetween(1, h))
    gain = F.try_divide(best, F.col("close")) - 1
    return _own(frame.withColumn(name or f"label_{h}d", F.when(gain > threshold, 1).otherwise(0)))


def label_future_return_regression(bars: DataFrame, h: int, name: str | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """Close h rows ahead over the close, minus one (null without it)."""
    frame, w = forward(bars, h, size)
    later = F.lead("close", h).over(w)
    return _own(frame.withColumn(name or f"fwd_return_{h}d", F.try_divide(later, F.col("close")) - 1))


def backtest_signals(bars: DataFrame, signal: str, h: int, position_size: float = 1000.0, size: int = BLOCK_ROWS) -> DataFrame:
    """Enter at the open of each signal row, leave at the close h rows later."""
    frame, w = forward(bars, h, size)
    frame = frame.withColumn("exit_price", F.lead("close", h).over(w)).withColumn("exit_date", F.lead("date", h).over(w))
    gain = F.try_divide(F.col("exit_price"), F.col("open")) - 1
    return (frame.where(F.col("own") & F.col(signal) & F.col("exit_price").isNotNull())
            .select("ticker", F.col("date").alias("entry_date"), F.col("open").alias("entry_price"), "exit_date",
                    "exit_price", gain.alias("return"), (gain * position_size).alias("pnl")))
