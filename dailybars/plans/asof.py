"""Backward as-of joins as equi-joins.

A market table has one row per date.  Spreading each row over the days until
the next one turns "last known value on or before" into equality on the date;
the spread table has one row per calendar day, so Spark decides by its size
whether to broadcast it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def spread_days(series: DataFrame, key: list[str], until: DataFrame, date: str = "date") -> DataFrame:
    """One row per key and calendar day, holding the latest row on or before it.

    ``until`` is a one-row frame with the last day that may be asked for (``last_day``).
    Rows of one key are ordered inside a year; only the first row of each year
    is looked up across years.
    """
    year = F.year(date)
    firsts = series.groupBy(*key, year.alias("y")).agg(F.min(date).alias("first_of_year"))
    order = W.partitionBy(*key).orderBy("y") if key else W.partitionBy(F.lit(0)).orderBy("y")
    following = firsts.withColumn("next_year", F.lead("first_of_year").over(order)).drop("first_of_year")
    inside = W.partitionBy(*key, "y").orderBy(date)
    spread = (series.withColumn("y", year)
              .join(following, [*key, "y"])
              .withColumn("upto", F.coalesce(F.lead(date).over(inside), F.col("next_year")))
              .crossJoin(F.broadcast(until))
              .withColumn("upto", F.coalesce(F.date_sub("upto", 1), F.greatest(F.col(date), F.col("last_day")))))
    return (spread.withColumn("day", F.explode(F.sequence(F.col(date), F.col("upto"))))
            .drop("y", "next_year", "upto", "last_day"))


def asof_by_ticker(left: DataFrame, right: DataFrame, left_date: str, right_date: str = "date") -> DataFrame:
    """Inner as-of join of (ticker, left_date) to the last right row on or before it.

    Right rows become validity intervals; both sides meet on (ticker, month) and
    the interval test picks exactly one right row per left row.
    """
    month = lambda d: F.year(d) * 12 + F.month(d)
    by_month = right.groupBy("ticker", month(right_date).alias("ym")).agg(F.min(right_date).alias("first_in_month"))
    starts = by_month.withColumn("next_month", F.lead("first_in_month").over(W.partitionBy("ticker").orderBy("ym")))
    inside = W.partitionBy("ticker", "ym").orderBy(right_date)
    last = left.agg(F.max(left_date).alias("last_day"))
    valid = (right.withColumn("ym", month(right_date))
             .join(starts.drop("first_in_month"), ["ticker", "ym"])
             .withColumn("upto", F.coalesce(F.lead(right_date).over(inside), F.col("next_month")))
             .drop("next_month", "ym")
             .crossJoin(F.broadcast(last))
             .withColumn("upto", F.coalesce(F.col("upto"), F.date_add(F.greatest(F.col("last_day"), F.col(right_date)), 1)))
             .withColumn("ym", F.explode(F.sequence(month(right_date), month(F.date_sub("upto", 1)))))
             .drop("last_day"))
    return (left.withColumn("ym", month(left_date))
            .join(valid, ["ticker", "ym"])
            .where((F.col(left_date) >= F.col(right_date)) & (F.col(left_date) < F.col("upto")))
            .drop("ym", "upto"))
