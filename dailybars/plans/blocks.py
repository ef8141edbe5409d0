"""Row numbers and time blocks, so that no ticker is ever one task.

Indicators look a bounded number of rows back (and labels a bounded number of
rows ahead).  A ticker's rows are therefore cut into blocks of ``size`` rows;
each block also gets the neighbouring rows its windows look at, and only the
rows a block owns are kept at the end.  A ticker shorter than one block is not
duplicated at all, a hot ticker becomes many independent groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK_ROWS = 8192


def number_rows(df: DataFrame, date: str = "date") -> DataFrame:
    """Add ``rn`` (1-based position within the ticker) and ``n_rows``.

    Positions come from row counts per (ticker, month), summed over earlier
    months, plus the position inside the month.  Only the month counts (at most
    12 per ticker and year) are ever ordered per ticker.
    """
    month = (F.year(date) * 12 + F.month(date)).alias("ym")
    counts = df.groupBy("ticker", month).agg(F.count(F.lit(1)).alias("in_month"))
    by_month = W.partitionBy("ticker").orderBy("ym")
    offsets = counts.select(
        "ticker", "ym",
        (F.sum("in_month").over(by_month) - F.col("in_month")).alias("before"),
        F.sum("in_month").over(W.partitionBy("ticker")).alias("n_rows"))
    inside = W.partitionBy("ticker", "ym").orderBy(date)
    return (df.withColumn("ym", month)
              .join(offsets, ["ticker", "ym"])
              .withColumn("rn", (F.col("before") + F.row_number().over(inside)).cast("bigint"))
              .drop("ym", "before"))


def into_blocks(df: DataFrame, back: int, ahead: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Copy each numbered row to every block that needs it.

    Adds ``blk`` and ``own`` (true in the one block the row belongs to).
    """
    at = F.col("rn") - 1
    block_of = lambda x: F.floor(x / F.lit(size))
    first = block_of(F.greatest(at - ahead, F.lit(0)))
    last = F.least(block_of(at + back), block_of(F.col("n_rows") - 1))
    return (df.withColumn("blk", F.explode(F.sequence(first, last)))
              .withColumn("own", F.col("blk") == block_of(at)))

