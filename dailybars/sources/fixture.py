"""Bar tables derived from the order-line tables (deterministic, any scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The sector of each derived ticker and the sectors' reference symbols.
SECTORS = {
    "ECONOMY": "Consumer Defensive", "SMALL": "Consumer Defensive",
    "MEDIUM": "Industrials", "STANDARD": "Industrials",
    "LARGE": "Communication Services", "PROMO": "Real Estate",
}
SYMBOL_OF = {"ECONOMY": "XLP", "SMALL": "XLP", "MEDIUM": "XLI", "STANDARD": "XLI", "LARGE": "XLK", "PROMO": "XLF"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    item = spark.read.parquet(f"{path}/lineitem.parquet")
    part = spark.read.parquet(f"{path}/part.parquet").select("p_partkey", F.col("p_type").alias("ticker"))
    key = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax"]
    price = F.round(100 * (1 - F.col("l_discount") + F.col("l_tax")) + F.col("l_quantity") / 10, 4)
    return item.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        "ticker", F.col("l_shipdate").cast("date").alias("date"), price.alias("px"),
        F.col("l_quantity").alias("q"), F.struct(*key).alias("k"))


def _bars(rows: DataFrame) -> DataFrame:
    """Aggregates combine map-side, so one busy ticker costs no more than its days."""
    return rows.groupBy("ticker", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"), F.sum("q").cast("bigint").alias("volume"))


def bars(spark: SparkSession, path: str) -> DataFrame:
    return _bars(lines(spark, path))


def market(spark: SparkSession, path: str) -> DataFrame:
    return _bars(lines(spark, path).withColumn("ticker", F.lit("SPY")))


def sector_bars(spark: SparkSession, path: str) -> DataFrame:
    symbol = F.create_map(*[F.lit(x) for kv in SYMBOL_OF.items() for x in kv])
    return _bars(lines(spark, path).withColumn("ticker", symbol[F.col("ticker")]).where("ticker is not null"))


def sector_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SECTORS.items()), "ticker string, sector string")


def raw_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars as text with mixed-case headers and fixed defects by day of month.

    13th: row twice; 17th: bad date; 5th: empty volume; 7th: zero volume;
    9th: negative open; 11th: high is not a number; 1 to 20 March 1998 missing.
    """
    b = bars(spark, path).where("date not between date'1998-03-01' and date'1998-03-20'")
    on = lambda d: F.day("date") == d
    text = b.select(
        "ticker", F.when(on(17), "no date").otherwise(F.col("date").cast("string")).alias("Date"),
        F.when(on(9), -F.col("open")).otherwise(F.col("open")).cast("string").alias("Open"),
        F.when(on(11), "n/a").otherwise(F.col("high").cast("string")).alias("High"), F.col("low").cast("string").alias("Low"),
        F.col("close").cast("string").alias("CLOSE"),
        F.when(on(5), "").when(on(7), "0").otherwise(F.col("volume").cast("string")).alias("Volume"),
        F.when(on(13), 2).otherwise(1).alias("copies"))
    return text.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def splits(bars_df: DataFrame) -> DataFrame:
    """Split coefficient 2 on one date of ECONOMY and 0.5 on one of SMALL, else 1."""
    split = (F.when((F.col("ticker") == "ECONOMY") & (F.col("date") == "1998-06-01"), 2.0)
             .when((F.col("ticker") == "SMALL") & (F.col("date") == "1999-03-01"), 0.5).otherwise(1.0))
    return bars_df.withColumn("split_coefficient", split)
