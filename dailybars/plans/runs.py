"""Run lengths that may span any number of blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.plans.blocks import BLOCK_ROWS, into_blocks
from dailybars.plans.first_exit import chain_ends, chain_from, next_beyond


def in_block():
    return W.partitionBy("ticker", "blk").orderBy("rn")


def add_jump_runs(df: DataFrame, value: str, jump: float, name: str, size: int) -> DataFrame:
    """Rows since ``value`` last moved by more than ``jump`` from one row to the next.

    The latest start inside the block, or else the latest one of any earlier
    block: only one row per block is ordered over a whole ticker.
    """
    frame = into_blocks(df, 1, size=size)
    return _runs(frame, F.abs(F.col(value) - F.lag(value).over(in_block())) > jump, value, name)


def add_direction_runs(df: DataFrame, value: str, name: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Rows since ``value`` last turned between rising and not rising, counting that row."""
    frame = into_blocks(df, 2, size=size).withColumn("up", F.coalesce(F.col(value) > F.lag(value).over(in_block()), F.lit(False)))
    return _runs(frame, F.col("up") != F.lag("up").over(in_block()), value, name).drop("up")


def _runs(frame: DataFrame, moved, value: str, name: str) -> DataFrame:
    order = in_block()
    frame = frame.withColumn("start", F.when((F.col("rn") == 1) | moved, F.col("rn"))).where("own")
    latest = frame.groupBy("ticker", "blk").agg(F.max("start").alias("latest"))
    earlier = W.partitionBy("ticker").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    before = latest.select("ticker", "blk", F.max("latest").over(earlier).alias("before"))
    here = F.max("start").over(order.rowsBetween(W.unboundedPreceding, 0))
    run = F.col("rn") - F.coalesce(F.col("here"), F.col("before")) + 1
    return (frame.withColumn("here", here).join(before, ["ticker", "blk"])
            .withColumn(name, F.when(F.col(value).isNull(), 0.0).otherwise(run.cast("double")))
            .drop("start", "here", "before", "blk", "own"))


def run_starts(x, rn, jump, anchor=None, start=0):
    """Start row of the run each row belongs to; a row more than ``jump`` off the value at a run's start begins another."""
    n, following = len(x), next_beyond(x, jump)
    off = np.ones(n, bool) if anchor is None else np.abs(x - anchor) > jump
    begins = chain_from(int(np.argmax(off)) if off.any() else n, following)
    mark = np.zeros(n, np.int64)
    mark[begins] = begins + 1
    mark = np.maximum.accumulate(mark)
    return np.where(mark > 0, rn[np.maximum(mark - 1, 0)], start)


def _exits(x, rn, jump):
    """What a block does to every anchor that could enter it.

    Only a new lowest or highest value can be the first to leave an entering
    anchor, so the block is described by those rows and where the runs that
    start at each of them end.
    """
    lowest, highest = np.minimum.accumulate(x), np.maximum.accumulate(x)
    rows = np.flatnonzero(np.r_[True, (x[1:] < lowest[:-1]) | (x[1:] > highest[:-1])][:len(x)])
    ends = chain_ends(next_beyond(x, jump))[rows]
    return x[rows].tolist(), x[ends].tolist(), rn[ends].tolist()


def add_anchored_runs(df: DataFrame, value: str, jump: float, name: str, size: int) -> DataFrame:
    """Rows since ``value`` left the value at the start of the run by more than ``jump``.

    Blocks are summarised in parallel, the summaries of a ticker are chained
    (one small row per block), then every block is walked from its known entry.
    """
    frame = into_blocks(df, 0, size=size).drop("own")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        seen, anchors, starts = _exits(pdf[value].to_numpy(), pdf["rn"].to_numpy(), jump)
        return pd.DataFrame({"ticker": pdf["ticker"].iloc[:1].values, "blk": pdf["blk"].iloc[:1].values,
                             "seen": [seen], "anchors": [anchors], "starts": [starts]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        anchor, start, out = None, 0, []
        for row in pdf.itertuples():
            out.append((row.ticker, row.blk, anchor, start))
            for v, a, s in zip(row.seen, row.anchors, row.starts):
                if anchor is None or abs(v - anchor) > jump:
                    anchor, start = a, s
                    break
        return pd.DataFrame(out, columns=["ticker", "blk", "anchor", "start"])

    columns = df.columns
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        anchor = pdf["anchor"].iloc[0]
        starts = run_starts(pdf[value].to_numpy(), pdf["rn"].to_numpy(), jump, None if pd.isna(anchor) else anchor, pdf["start"].iloc[0])
        pdf[name] = (pdf["rn"] - starts + 1).astype(float)
        return pdf[[*columns, name]]

    brief = frame.select("ticker", "blk", "rn", value).groupBy("ticker", "blk").applyInPandas(
        summarise, "ticker string, blk bigint, seen array<double>, anchors array<double>, starts array<bigint>")
    entry = brief.groupBy("ticker").applyInPandas(chain, "ticker string, blk bigint, anchor double, start bigint")
    return (frame.join(entry, ["ticker", "blk"]).groupBy("ticker", "blk")
            .applyInPandas(finish, ", ".join([*fields, f"{name} double"])))


def fill_forward(df: DataFrame, value: str, size: int) -> DataFrame:
    """Latest non-null ``value`` on or before each row, over any number of blocks."""
    frame = into_blocks(df, 0, size=size).drop("own")
    order = W.partitionBy("ticker", "blk").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    latest = frame.where(F.col(value).isNotNull()).groupBy("ticker", "blk").agg(F.max_by(value, "rn").alias("latest"))
    blocks = frame.select("ticker", "blk").distinct().join(latest, ["ticker", "blk"], "left")
    earlier = W.partitionBy("ticker").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select("ticker", "blk", F.last("latest", ignorenulls=True).over(earlier).alias("before"))
    here = F.last(value, ignorenulls=True).over(order)
    return frame.withColumn("here", here).join(before, ["ticker", "blk"]).withColumn(
        value, F.coalesce("here", "before")).drop("here", "before", "blk")
