"""Cleaning and checking raw bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.plans.blocks import BLOCK_ROWS, into_blocks, number_rows

PRICES = ["open", "high", "low", "close"]
REQUIRED = [*PRICES, "volume"]


def normalise_headers(raw: DataFrame) -> DataFrame:
    """Lower-case names, the first column after the ticker becomes ``date``; required columns are checked."""
    names = [c.lower() for c in raw.columns]
    first = next(i for i, c in enumerate(names) if c != "ticker")
    names[first] = "date"
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return raw.toDF(*names)


def number(column: str):
    """Double, or null where the text is not a number (or is NaN)."""
    value = F.col(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(value):
    return F.abs(value) < F.lit(float("inf"))


def parse_rows(raw: DataFrame) -> DataFrame:
    """Strict dates, rows without one dropped, exact duplicates dropped, numbers parsed.

    Volume that is missing or infinite becomes 0 (``volume_replaced`` marks it).
    """
    df = normalise_headers(raw)
    df = df.withColumn("date", F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd")).where("date is not null").dropDuplicates()
    volume = number("volume")
    usable = F.coalesce(finite(volume), F.lit(False))
    extra = {"adj close": "adj_close"}
    df = df.withColumns({c: number(c) for c in [*PRICES, *[x for x in ("adj close", "adj_close", "split_coefficient") if x in df.columns]]})
    df = df.withColumns({"volume_replaced": ~usable, "volume": F.when(usable, volume).otherwise(0.0).cast("bigint")})
    return df.withColumnsRenamed({k: v for k, v in extra.items() if k in df.columns})


def positive_rows():
    """All of open, high, low, close and volume present and above zero."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    return ok


def clean_bars(raw: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Parsed rows with valid prices and volume, split-adjusted where coefficients are given."""
    df = parse_rows(raw).where(positive_rows()).drop("volume_replaced")
    return split_adjust(df, size) if "split_coefficient" in df.columns else df


def split_adjust(df: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Prices times the running product of split coefficients, volume over it.

    Products are taken inside blocks; one product per block is chained per ticker.
    """
    frame = into_blocks(number_rows(df), 0, size=size).drop("own")
    inside = W.partitionBy("ticker", "blk").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    blocks = frame.groupBy("ticker", "blk").agg(F.product("split_coefficient").alias("in_block"))
    earlier = W.partitionBy("ticker").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select("ticker", "blk", F.coalesce(F.product("in_block").over(earlier), F.lit(1.0)).alias("before"))
    factor = F.col("before") * F.product("split_coefficient").over(inside)
    out = frame.join(before, ["ticker", "blk"]).withColumn("factor", factor)
    out = out.withColumns({c: F.col(c) * F.col("factor") for c in PRICES})
    out = out.withColumn("volume", F.round(F.try_divide(F.col("volume"), F.col("factor"))).cast("bigint"))
    return out.drop("split_coefficient", "factor", "before", "blk", "rn", "n_rows")


def cleaning_statistics(raw: DataFrame) -> DataFrame:
    """Rows before, after and dropped and volumes replaced per ticker, with the share of all tickers' rows."""
    before = raw.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows_before"))
    after = parse_rows(raw).groupBy("ticker").agg(
        F.count(F.when(positive_rows(), 1)).alias("rows_after"), F.count(F.when(F.col("volume_replaced"), 1)).alias("volume_replaced"))
    t = before.join(after, "ticker", "left").na.fill(0)
    return t.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after")).withColumn(
        "kept_pct", share_of(F.col("rows_after"), F.col("rows_before")))


def share_of(a, b):
    return F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.na.drop("any")


def drop_empty_bars(df: DataFrame) -> DataFrame:
    """Rows with at least one price or volume, and with a close."""
    return df.na.drop("all", subset=REQUIRED).na.drop(subset=["close"])


def check_bars(bars: DataFrame) -> DataFrame:
    """Counts of price and volume problems per ticker."""
    n = lambda c: F.count(F.when(c, 1))
    c = F.col
    return bars.groupBy("ticker").agg(
        *[n(c(p) <= 0).alias(f"bad_{p}") for p in PRICES], n(c("high") < c("low")).alias("high_below_low"),
        n(c("high") < c("close")).alias("high_below_close"), n(c("low") > c("close")).alias("low_above_close"),
        n(c("volume") < 0).alias("negative_volume"))


def find_gaps(bars: DataFrame, days: int = 10, size: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive dates of a ticker more than ``days`` calendar days apart."""
    frame = into_blocks(number_rows(bars.select("ticker", "date")), 1, size=size)
    before = F.lag("date").over(W.partitionBy("ticker", "blk").orderBy("rn"))
    return (frame.withColumn("gap_start", before).where(F.col("own") & (F.datediff("date", "gap_start") > days))
            .select("ticker", "gap_start", F.col("date").alias("gap_end"), F.datediff("date", "gap_start").alias("days")))


def check_integrity(bars: DataFrame) -> DataFrame:
    """Null dates and repeated dates per ticker."""
    per_day = bars.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("ticker").agg(
        F.sum(F.when(F.col("date").isNull(), F.col("n")).otherwise(0)).alias("null_dates"),
        F.sum(F.when(F.col("date").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_dates"))


EXPECTED = {"date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}


def wrong_types(bars: DataFrame) -> list[str]:
    have = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    return [c for c, t in EXPECTED.items() if have.get(c) != t]


def one_per_date(df: DataFrame, keep: str, priority: str) -> DataFrame:
    """One row per (ticker, date): the one with the lowest or highest ``priority``."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in ("ticker", "date", priority)]
    return (df.groupBy("ticker", "date").agg(pick(F.struct(*rest), priority).alias("r"))
            .select("ticker", "date", "r.*"))


def append_new(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored rows plus fetched ones after each ticker's last stored date; stored rows win."""
    last = stored.groupBy("ticker").agg(F.max("date").alias("last_date"))
    fresh = fetched.join(last, "ticker", "left").where(
        F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")
    both = stored.withColumn("source", F.lit(0)).unionByName(fresh.withColumn("source", F.lit(1)))
    return one_per_date(both, "first", "source")


def next_trading_day(bars: DataFrame) -> DataFrame:
    """The day after the latest stored date."""
    return bars.agg(F.max("date").alias("latest"), F.date_add(F.max("date"), 1).alias("next_day"))


def market_indicators(series: DataFrame) -> DataFrame:
    """Change, 5 and 10 row means, 5 row momentum and 20 row z-score of one close series; incomplete rows dropped."""
    frame = into_blocks(number_rows(series.where("close is not null")), 20)
    order = W.partitionBy("ticker", "blk").orderBy("rn")
    last = lambda k: order.rowsBetween(-(k - 1), 0)
    c = F.col("close")
    full = lambda k, x: F.when(F.col("rn") >= k, x)
    frame = frame.withColumns({
        "pct_change": F.try_divide(c, F.lag("close").over(order)) - 1,
        "ma_5": full(5, F.avg("close").over(last(5))), "ma_10": full(10, F.avg("close").over(last(10))),
        "momentum_5": c - F.lag("close", 5).over(order),
        "zscore_20": full(20, F.try_divide(c - F.avg("close").over(last(20)), F.stddev_samp("close").over(last(20))))})
    return (frame.where("own").select("date", "close", "pct_change", "ma_5", "ma_10", "momentum_5", "zscore_20").na.drop())
