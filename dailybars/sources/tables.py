"""Reading and writing bar, feature, trade and list tables."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dailybars.plans.ordered import with_totals

# Market and sector reference symbols, never feature or training rows.
REFERENCE_TICKERS = ["SPY", "XLK", "XLF", "XLV", "XLE", "XLI", "XLY", "XLP", "XLB", "XLU", "XLC", "XLRE"]

RAW = "date string, open string, high string, low string, close string, volume string"
CLEAN = "ticker string, date date, open double, high double, low double, close double, volume bigint"
TRADES = ("ticker string, entry_date date, entry_price double, exit_date date, exit_price double, `return` double, "
          "pnl double, holding_days int, exit_reason string")
IMPORTANCE = "feature string, importance double, rank int, pct double, cumulative_pct double"
PRICE_COLUMNS = ["open", "high", "low", "close", "volume", "adj close", "adj_close"]


def first_lines(spark: SparkSession, folder: str, together: int = 16) -> list[tuple[str, str]]:
    """Name and first line of every file under a folder, by the cluster's file system: a listing and a few bytes a file."""
    java, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = java.org.apache.hadoop
    root = hadoop.fs.Path(folder)
    files, codecs = root.getFileSystem(conf), hadoop.io.compress.CompressionCodecFactory(conf)
    listed, found = files.listFiles(root, True), []
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName()[0] not in "._":
            found.append(path)

    def first(path):
        stream, codec = files.open(path), codecs.getCodec(path)
        reader = java.java.io.BufferedReader(java.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        try:
            return path.toString(), reader.readLine() or ""
        finally:
            reader.close()

    with ThreadPool(together) as pool:
        return pool.map(first, found)


def read_raw(spark: SparkSession, folder: str, schema: str = RAW) -> DataFrame:
    """One CSV (or folder of CSVs) per ticker; columns by the name in each file's header, the ticker from the path.

    Names are lower-cased and may stand in any order; columns of ``schema`` that a file lacks are null, others are
    kept.  Headers come from the first line of each file; files are then read once, together by header, of which there
    are a few.  A file without a date column has no rows.
    """
    by_header = {}
    for file, header in first_lines(spark, folder):
        columns = tuple(c.strip().strip('"').strip().lower() for c in header.split(","))
        if "date" in columns:
            by_header.setdefault(columns, []).append(file)
    wanted = [f.name for f in T.StructType.fromDDL(schema)]
    out = spark.createDataFrame([], schema + ", file string")
    for columns, files in sorted(by_header.items()):
        fields = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = spark.read.csv(files, header=True, schema=fields, enforceSchema=True)
        out = out.unionByName(df.withColumn("file", F.input_file_name()), allowMissingColumns=True)
    ticker = F.regexp_extract("file", r"([^/=]+)(\.csv|/part-[^/]*)$", 1).alias("ticker")
    return out.select(*wanted, *[c for c in out.columns if c not in [*wanted, "file", "ticker"]], ticker)


def write_clean(bars: DataFrame, folder: str, mode: str = "overwrite", per_ticker: bool = True) -> None:
    """Parquet; per ticker folders suit hundreds of tickers, otherwise sorted files carry ticker statistics."""
    if per_ticker:
        bars.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.mode(mode).partitionBy("ticker").parquet(folder)
    else:
        bars.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.mode(mode).parquet(folder)


def read_clean(spark: SparkSession, folder: str, extra: str = "") -> DataFrame:
    return spark.read.schema(CLEAN + extra).parquet(folder)


def write_features(features: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Doubles are narrowed to floats only here; files are ranged by ticker and date so reads can skip."""
    narrow = [F.col(f.name).cast("float").alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
              for f in features.schema.fields]
    features.select(*narrow).repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.mode(mode).parquet(folder)


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(folder)


def without_references(df: DataFrame) -> DataFrame:
    return df.where(~F.col("ticker").isin(REFERENCE_TICKERS))


def training_scan(features: DataFrame, names) -> DataFrame:
    """Training rows: no reference tickers, features as floats."""
    keep = [c for c in ("ticker", "date", *[c for c in features.columns if c.startswith("label_")]) if c in features.columns]
    return without_references(features).select(*keep, *[F.col(n).cast("float").alias(n) for n in names])


def validation_scan(features: DataFrame, names, label: str, start=None, end=None) -> DataFrame:
    """Labelled rows of a date range; features that are absent or null become 0."""
    have = set(features.columns)
    df = features.where(F.col(label).isNotNull())
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.select("ticker", "date", label, *[(F.coalesce(F.col(n), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names])


def sampled_scan(df: DataFrame, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows, from each ticker at most a tenth of that: the first in a seeded hash order."""
    drawn = df.withColumn("drawn", F.md5(F.concat_ws("|", "ticker", F.col("date").cast("string"), F.lit(str(seed)))))
    own = with_totals(drawn, ["drawn", "date"], ["ticker"]).where(F.col("pos") <= rows // 10).select(drawn.columns)
    return with_totals(own, ["drawn", "ticker", "date"]).where(F.col("pos") <= rows).select(df.columns)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """First column of a headerless CSV."""
    return spark.read.csv(path, header=False).select(F.trim("_c0").alias("ticker")).where("ticker <> ''").distinct()


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe, "ticker", "left_semi")


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = {"ticker", "sector"} - set(df.columns)
    if missing:
        raise ValueError(f"sector map lacks {sorted(missing)}")
    return df.select(F.upper(F.trim("ticker")).alias("ticker"), F.trim("sector").alias("sector")).dropDuplicates(["ticker"])


def write_sectors(df: DataFrame, path: str) -> None:
    df.select("ticker", "sector").write.mode("overwrite").csv(path, header=True)


def reference_series(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    """Market bars (one symbol) or all sector bars of a table that holds both."""
    if symbol:
        return bars.where(F.col("ticker") == symbol)
    return bars.where(F.col("ticker").isin(REFERENCE_TICKERS[1:]))


def read_market(spark: SparkSession, folder: str, symbol: str = "SPY") -> DataFrame:
    """Stored market bars: Parquet if it is there, else CSV."""
    try:
        return spark.read.schema(CLEAN).parquet(f"{folder}/{symbol}.parquet")
    except Exception as error:  # no such path
        if "PATH_NOT_FOUND" not in str(error):
            raise
    return spark.read.csv(f"{folder}/{symbol}.csv", header=True, schema=CLEAN.replace("ticker string, ", "")).withColumn("ticker", F.lit(symbol))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TRADES)


def write_trades(trades: DataFrame, path: str) -> None:
    """The trade log; an empty one keeps its header."""
    trades.write.mode("overwrite").csv(path, header=True)


def empty_trades(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRADES)


def write_importance(table: DataFrame, path: str) -> None:
    table.select("feature", "importance", "rank", "pct", "cumulative_pct").write.mode("overwrite").csv(path, header=True)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def pending(inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of tickers that have no stored output yet."""
    return inputs.join(stored.select("ticker").distinct(), "ticker", "left_anti")
