"""One query per operator, each with its DuckDB SQL where it has one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from checks import duck_trades as dt
from checks.duck_features import BARS, feature_sql
from dailybars.features.build import SECTOR_SYMBOL, build_features, resample, sector_symbols, week_label
from dailybars.features.categories import CATEGORY
from dailybars.features.build import add_series, last_friday, last_month_end, price_columns
from dailybars.features.v1_v2 import V1
from dailybars.features.v3_composite import V3
from dailybars.operators import clean, filters, incremental, labels, models, quality, reports, scoring, stops, trades
from dailybars.plans import runs
from dailybars.plans.blocks import number_rows
from dailybars.plans.cut import shared_folder, written
from dailybars.sources import fixture as fx, tables

H, TARGET, LABEL_T, FEATURES = dt.H, dt.TARGET, dt.LABEL_T, dt.FEATURES
SIGNAL = "rsi14 < -0.08"
QUERIES, SQL = {}, {}


def shown(df):
    """Every double to six decimals (the nudge keeps exact ties off the rounding edge)."""
    return df.select(*[(F.round(F.col(f"`{f.name}`") + 1.3e-8, 6) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def add(key, run, sql=None, doubles=()):
    QUERIES[key] = lambda spark, path: shown(run(spark, path))
    if sql is not None:
        SQL[key] = dt.rounded(sql, doubles)


def folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/check-{uuid.uuid4().hex}"


# ---- shared inputs ---------------------------------------------------------
def ft(spark, path, names=FEATURES):
    df = build_features(fx.bars(spark, path), names, market=fx.market(spark, path), prices=True)
    df = labels.label_future_return(df, H, LABEL_T)
    return written(df.withColumn("probability", F.round((1 - F.col("rsi14")) / 2 + 1.3e-8, 3)), "features")


STOP = {"constant": stops.StopConfig("constant", 0.075), "half": None,
        "adaptive_atr": stops.StopConfig("adaptive_atr"), "swing_atr": stops.StopConfig("swing_atr")}


def run(spark, path, stop="constant", signal=SIGNAL, **kw):
    return written(trades.run_backtest(ft(spark, path), F.expr(signal), H, 1000.0, TARGET, STOP[stop], **kw), "trades")


def with_(*ctes):
    return f"with recursive {', '.join(ctes)} "


FT = dt.table()
TR = f"{FT}, {dt.trades(SIGNAL)}"
BARS_SQL = f"with {BARS} "
P5 = ["open", "high", "low", "close"]
NUMBERS = [c for c in FEATURES]
TRADE_DOUBLES = ["entry_price", "exit_price", '"return"', "pnl"]
TRADE_COLUMNS = 'ticker, entry_date, entry_price, exit_date, exit_price, "return", pnl, holding_days, exit_reason'
RAW_SQL = f"""{BARS}, raw as (
  select ticker, case when day(date) = 17 then 'no date' else cast(date as varchar) end as date,
    cast(case when day(date) = 9 then -open else open end as varchar) as open,
    case when day(date) = 11 then 'n/a' else cast(high as varchar) end as high, cast(low as varchar) as low, cast(close as varchar) as close,
    case when day(date) = 5 then '' when day(date) = 7 then '0' else cast(volume as varchar) end as volume
  from bars, range(2) r(i) where (i = 0 or day(date) = 13) and date not between date '1998-03-01' and date '1998-03-20'),
parsed as (select distinct ticker, try_cast(date as date) as date, try_cast(open as double) as open, try_cast(high as double) as high,
    try_cast(low as double) as low, try_cast(close as double) as close,
    coalesce(try_cast(volume as double), 0) as volume, try_cast(volume as double) is null as replaced
  from raw where try_cast(date as date) is not null),
cleaned as (select ticker, date, open, high, low, close, cast(volume as bigint) as volume from parsed
  where open > 0 and high > 0 and low > 0 and close > 0 and volume > 0)"""


def raw(spark, path):
    return fx.raw_bars(spark, path)


def cleaned(spark, path):
    return clean.clean_bars(raw(spark, path)).select("ticker", "date", *P5, "volume")


# ---- sources and sinks -------------------------------------------------------
def a01(spark, path):
    to = folder(spark)
    rows = raw(spark, path)
    early = F.col("ticker") < "M"
    turned = rows.where(~early).select(F.col("close").alias("Close"), F.col("volume").alias("VOLUME"), F.col("date").alias("Date"), "high", "low", "open", F.lit("1.0").alias("Adj Close"), "ticker")
    rows.where(early).repartition("ticker").write.partitionBy("ticker").csv(f"{to}/a", header=True)
    turned.repartition("ticker").write.partitionBy("ticker").csv(f"{to}/b", header=True)
    number = lambda c: F.sum(F.expr(f"try_cast({c} as double)")).alias(f"sum_{c}")
    return tables.read_raw(spark, to).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.count(F.when(F.col("date") == "no date", 1)).alias("bad_dates"), F.count("adj close").alias("adjusted"), *[number(c) for c in P5])


add("a01_raw_scan", a01, f"with {RAW_SQL} select ticker, count(*) as rows, min(date) as first, count(*) filter (where date = 'no date') as bad_dates, count(*) filter (where ticker >= 'M') as adjusted, "
    + ", ".join(f"sum(try_cast({c} as double)) as sum_{c}" for c in P5) + " from raw group by ticker", [f"sum_{c}" for c in P5])


def a02(spark, path):
    to = folder(spark)
    tables.write_clean(cleaned(spark, path), to)
    return tables.read_clean(spark, to).select("ticker", "date", *P5, "volume")


CLEAN_SQL = f"with {RAW_SQL} select * from cleaned"
add("a02_clean_sink", a02, CLEAN_SQL, P5)


def a03(spark, path):
    to = folder(spark)
    tables.write_clean(fx.bars(spark, path), to, per_ticker=False)
    return tables.read_clean(spark, to).where("date >= '1999-01-01'").select("ticker", "date", "close")


add("a03_clean_scan", a03, BARS_SQL + "select ticker, date, close from bars where date >= '1999-01-01'", ["close"])


def a04(spark, path):
    to = folder(spark)
    tables.write_features(ft(spark, path).select("ticker", "date", "rsi14", "roc10"), to)
    return tables.read_features(spark, to).select("ticker", "date", *[(F.round(F.col(c).cast("double") + 1.3e-8, 4) + 0.0).alias(c) for c in ("rsi14", "roc10")])


add("a04_feature_sink", a04, FT + " select ticker, date, round(cast(cast(rsi14 as float) as double) + 1.3e-8, 4) + 0e0 as rsi14, round(cast(cast(roc10 as float) as double) + 1.3e-8, 4) + 0e0 as roc10 from ft", ["rsi14", "roc10"])


def with_references(df):
    return df.unionByName(df.where("ticker = 'PROMO'").withColumn("ticker", F.lit("SPY"))).unionByName(df.where("ticker = 'SMALL'").withColumn("ticker", F.lit("XLK")))


add("a05_training_scan",
    lambda s, p: tables.training_scan(with_references(ft(s, p)), ["roc10"]).select("ticker", "date", "label_5d", F.round(F.col("roc10").cast("double") + 1.3e-8, 4).alias("roc10")),
    FT + " select ticker, date, label_5d, round(cast(cast(roc10 as float) as double) + 1.3e-8, 4) as roc10 from ft where ticker not in ('SPY','XLK')", ["roc10"])
add("a06_validation_scan",
    lambda s, p: tables.validation_scan(ft(s, p), ["rsi14", "roc10", "not_there"], "label_5d", "1998-01-01", "1999-12-31"),
    FT + " select ticker, date, label_5d, coalesce(rsi14, 0) as rsi14, coalesce(roc10, 0) as roc10, 0e0 as not_there from ft where date between '1998-01-01' and '1999-12-31'",
    ["rsi14", "roc10", "not_there"])
add("a07_sampled_scan", lambda s, p: tables.sampled_scan(fx.bars(s, p), 1500).select("ticker", "date", "close"),
    BARS_SQL.rstrip() + """, drawn as (select *, md5(ticker || '|' || cast(date as varchar) || '|42') as h from bars),
    own as (select *, row_number() over (partition by ticker order by h, date) as nr from drawn),
    whole as (select *, row_number() over (order by h, ticker, date) as place from own where nr <= 150)
    select ticker, date, close from whole where place <= 1500""", ["close"])


def w19(spark, path):
    return runs.add_direction_runs(number_rows(fx.bars(spark, path)), "close", "run", 512).select("ticker", "date", F.col("run").cast("bigint").alias("run"))


add("w19_runs", w19, BARS_SQL.rstrip() + """, d as (select *, row_number() over t as rn, coalesce(cast(close > lag(close) over t as integer), 0) as up from bars window t as (partition by ticker order by date)),
    s as (select *, case when rn = 1 or up <> lag(up) over (partition by ticker order by rn) then rn end as start from d)
    select ticker, date, rn - last_value(start ignore nulls) over (partition by ticker order by rn) + 1 as run from s""")


def a08(spark, path):
    to = folder(spark)
    fx.bars(spark, path).select("ticker").distinct().where("ticker like '%M%'").write.csv(to)
    return tables.in_universe(fx.bars(spark, path), tables.read_universe(spark, to))


add("a08_universe", a08, BARS_SQL + "select * from bars where ticker like '%M%'", P5)


def a09(spark, path):
    to = folder(spark)
    tables.write_sectors(fx.sector_map(spark).join(fx.bars(spark, path).select("ticker").distinct(), "ticker", "left_semi"), to)
    return fx.bars(spark, path).join(tables.read_sectors(spark, to), "ticker").groupBy("sector").agg(F.count(F.lit(1)).alias("bars"))


SECTORS_SQL = "sectors(ticker, sector) as (values " + ", ".join(f"('{k}','{v}')" for k, v in fx.SECTORS.items()) + ")"
add("a09_a10_sector_map", a09, f"with {BARS}, {SECTORS_SQL} select sector, count(*) as bars from bars join sectors using (ticker) group by sector")


def a11(spark, path):
    to = folder(spark)
    tables.write_clean(fx.market(spark, path), f"{to}/SPY.parquet", per_ticker=False)
    return tables.read_market(spark, to).select("date", "close", "volume")


add("a11_market_scan", a11, BARS_SQL + "select date, close, volume from market", ["close"])
add("a12_sector_scan", lambda s, p: tables.reference_series(fx.sector_bars(s, p).unionByName(fx.market(s, p))).select("ticker", "date", "close"),
    "with " + BARS + ", so(ticker, symbol) as (values ('ECONOMY','XLP'),('SMALL','XLP'),('MEDIUM','XLI'),('STANDARD','XLI'),('LARGE','XLK'),('PROMO','XLF')) "
    "select symbol as ticker, date, arg_max(px, k) as close from x join so using (ticker) group by symbol, date", ["close"])


def a13(spark, path):
    to = folder(spark)
    tables.write_trades(run(spark, path).select(*trades.TRADE_FIELDS), to)
    return tables.read_trades(spark, to)


add("a13_a14_trade_log", a13, TR + f" select {TRADE_COLUMNS} from trades", TRADE_DOUBLES)

# Importance of a feature here: size of its correlation with the label.
IMP = ["rsi14", "atr14_normalized", "close_position_in_range", "candle_body_pct", "volatility_21d", "relative_volume", "roc10", "sma20_ratio"]


def importances(spark, path, label="label_5d"):
    t = quality.measure(ft(spark, path).where("rsi14 is not null and volatility_21d is not null and roc10 is not null").withColumn("y", F.col(label).cast("double")), IMP, importance=lambda c: F.abs(F.covar_samp(c, F.col("y")) / (F.stddev_samp(c) * F.stddev_samp(F.when(c.isNotNull(), F.col("y"))))))
    return t.withColumn("importance", F.when(F.col("importance") < 0.005, 0.0).otherwise(F.round(F.col("importance"), 6)))


IMP_SQL = FT + ", good as (select * from ft where rsi14 is not null and volatility_21d is not null and roc10 is not null), imp as (select feature, case when i < 0.005 then 0e0 else round(i, 6) end as importance from (" + " union all ".join(
    f"select '{f}' as feature, abs(corr({f}, cast(label_5d as double))) as i from good" for f in IMP) + "))"
RANKED = "ranked as (select feature, importance, row_number() over (order by importance desc, feature) as rank, importance * 100e0 / sum(importance) over () as pct, sum(importance) over (order by importance desc, feature rows unbounded preceding) * 100e0 / sum(importance) over () as cumulative_pct from imp)"


def a15(spark, path):
    to = folder(spark)
    tables.write_importance(quality.importance_table(importances(spark, path)), to)
    return spark.read.csv(to, header=True, schema=tables.IMPORTANCE)


add("a15_importance_sink", a15, f"{IMP_SQL}, {RANKED} select feature, importance, cast(rank as integer) as rank, pct, cumulative_pct from ranked", ["importance", "pct", "cumulative_pct"])


def a16(spark, path):
    to = folder(spark)
    tables.export_csv(fx.bars(spark, path), to)
    back = spark.read.csv(to, header=True, schema=tables.CLEAN)
    return quality.table_shape(back)


add("a16_inspect_export", a16, BARS_SQL + "select count(*) as rows, 7 as columns, min(date) as first_date, max(date) as last_date from bars")
add("a17_resume", lambda s, p: tables.pending(fx.bars(s, p), fx.bars(s, p).where("ticker > 'M'")), BARS_SQL + "select * from bars where ticker <= 'M'", P5)


def a18(spark, path):
    b = fx.bars(spark, path)
    stored = b.where("date < '2000-01-01' and not (ticker = 'LARGE')").withColumn("close", F.col("close") + 1)
    return clean.append_new(stored, b.where("date >= '1999-06-01'"))


add("a18_append", a18, BARS_SQL + "select ticker, date, open, high, low, close + case when date < '2000-01-01' and ticker <> 'LARGE' then 1 else 0 end as close, volume from bars "
    "where (date < '2000-01-01' and ticker <> 'LARGE') or (date >= '1999-06-01' and ticker = 'LARGE') or date >= '2000-01-01'", P5)
add("a19_latest_date", lambda s, p: clean.next_trading_day(fx.bars(s, p)), BARS_SQL + "select max(date) as latest, max(date) + 1 as next_day from bars")

# ---- projections and filters -----------------------------------------------
add("p01_p06_clean_rows", cleaned, CLEAN_SQL, P5)
add("p01_header_names", lambda s, p: clean.normalise_headers(raw(s, p)).groupBy("ticker").agg(F.count("close").alias("closes")),
    f"with {RAW_SQL} select ticker, count(close) as closes from raw group by ticker")
add("p02_price_choice", lambda s, p: price_columns(fx.bars(s, p).withColumn("adj_close", F.col("close") / 2)).select("ticker", "date", "c", "h"),
    BARS_SQL + "select ticker, date, close / 2 as c, high as h from bars", ["c", "h"])
add("p03_p05_parse", lambda s, p: clean.parse_rows(raw(s, p)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.count("high").alias("highs"), F.count(F.when(F.col("volume_replaced"), 1)).alias("replaced"), F.sum("volume").alias("volume")),
    f"with {RAW_SQL} select ticker, count(*) as rows, count(high) as highs, count(*) filter (where replaced) as replaced, cast(sum(volume) as bigint) as volume from parsed group by ticker")
add("p06_positive_rows", lambda s, p: clean.parse_rows(raw(s, p)).where(clean.positive_rows()).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")),
    f"with {RAW_SQL} select ticker, count(*) as rows from cleaned group by ticker")
add("p07_drop_incomplete", lambda s, p: clean.drop_incomplete(ft(s, p)).select("ticker", "date", "rsi14"),
    FT + " select ticker, date, rsi14 from ft where " + " and ".join(f"{f} is not null" for f in FEATURES), ["rsi14"])
add("p08_drop_empty", lambda s, p: clean.drop_empty_bars(fx.bars(s, p).withColumns({
        c: F.when(F.day("date") != 3, F.col(c)) for c in ("open", "high", "low", "volume")}).withColumn("close", F.when(~F.day("date").isin(3, 4), F.col("close")))),
    BARS_SQL + "select * from bars where day(date) not in (3, 4)", P5)
add("p09_reference_tickers", lambda s, p: tables.without_references(fx.bars(s, p).unionByName(fx.market(s, p))), BARS_SQL + "select * from bars", P5)
add("p10_feature_columns", lambda s, p: (lambda d: d.select("ticker", "date", *scoring.feature_columns(d, ["roc10", "rsi14"])))(ft(s, p)),
    FT + " select ticker, date, rsi14, roc10 from ft", ["rsi14", "roc10"])
add("p11_matrix", lambda s, p: scoring.prepare_matrix(ft(s, p).select("ticker", "date", (F.col("relative_volume") * 1e6).alias("relative_volume"), "rsi14"), ["relative_volume", "rsi14"]),
    FT + " select ticker, date, case when relative_volume is null then 0e0 else greatest(-1e6, least(1e6, relative_volume * 1e6)) end as relative_volume, coalesce(rsi14, 0e0) as rsi14 from ft", ["relative_volume", "rsi14"])
add("p12_p13_missing_features", lambda s, p: scoring.fill_for_scoring(scoring.fill_missing_features(ft(s, p).select("ticker", "date", "rsi14", "roc10"), ["rsi14", "roc10", "gone"]), ["rsi14", "gone"]),
    FT + " select ticker, date, rsi14, roc10, 0e0 as gone from ft", ["rsi14", "roc10", "gone"])
MY_FILTERS = [("close_position_in_range", ">", 0.3), ("rsi14", "<=", 0.2), ("volatility_21d", "<", 0.08), ("relative_volume", ">=", 0.5), ("absent", ">", 1.0)]
MY_SQL = "coalesce(close_position_in_range > 0.3 and rsi14 <= 0.2 and volatility_21d < 0.08 and relative_volume >= 0.5, false)"
add("p14_entry_filters", lambda s, p: filters.apply_entry_filters(ft(s, p), MY_FILTERS).select("ticker", "date", "rsi14"), FT + f" select ticker, date, rsi14 from ft where {MY_SQL}", ["rsi14"])
LATEST = "latest as (select * from ft qualify row_number() over (partition by ticker order by date desc) = 1)"
add("p15_latest_filters", lambda s, p: filters.apply_entry_filters(scoring.latest_rows(ft(s, p)), MY_FILTERS).select("ticker", "date", "rsi14"),
    f"{FT}, {LATEST} select ticker, date, rsi14 from latest where {MY_SQL}", ["rsi14"])


def analysed(spark, path, stop="constant", names=FEATURES):
    """Trades with the features of their entry date."""
    features = ft(spark, path, names)
    t = trades.run_backtest(features, F.expr(SIGNAL), H, 1000.0, TARGET, STOP[stop]).drop(*trades.STOP_FIELDS)
    return written(scoring.entry_features(written(t, "trades"), features, names), "analysed")


AN = f"{TR}, analysed as (select t.*, {', '.join('f.' + n for n in FEATURES)} from trades t join ft f on f.ticker = t.ticker and f.date = t.entry_date)"
add("p16_trade_filters", lambda s, p: filters.apply_entry_filters(analysed(s, p), MY_FILTERS).select("ticker", "entry_date", "pnl"),
    f"{AN} select ticker, entry_date, pnl from analysed where {MY_SQL}", ["pnl"])


def preset_sql(preset):
    return " and ".join(f"coalesce({f} {op} {v}, false)" for f, op, v in preset if f in FEATURES) or "true"


add("p17_default_preset", lambda s, p: filters.apply_entry_filters(ft(s, p), filters.DEFAULT_FILTERS).select("ticker", "date"), f"{FT} select ticker, date from ft where {preset_sql(filters.DEFAULT_FILTERS)}")
add("p18_recommended_preset", lambda s, p: filters.apply_entry_filters(ft(s, p), filters.RECOMMENDED_FILTERS).select("ticker", "date"), f"{FT} select ticker, date from ft where {preset_sql(filters.RECOMMENDED_FILTERS)}")


def preset_counts(spark, path, preset):
    """Rows that pass each filter of a preset alone, and all of them, over every feature the set defines."""
    names = defined(preset)
    df = build_features(fx.bars(spark, path), names, market=fx.market(spark, path))
    rows = [(f"{f} {op} {v}", filters.passes((f, op, v))) for f, op, v in preset if f in names] + [("all", filters.passes_all(df.columns, preset))]
    return df.agg(F.array(*[F.struct(F.lit(n).alias("filter"), F.count(F.when(c, 1)).alias("rows")) for n, c in rows]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def defined(preset):
    return [f for f, _, _ in preset if f in V3]


def preset_counts_sql(preset):
    names = defined(preset)
    one = lambda f, op, v: f"coalesce({f} {op} {v}, false)"
    rows = [(f"{f} {op} {v}", one(f, op, v)) for f, op, v in preset if f in names]
    rows.append(("all", " and ".join(c for _, c in rows)))
    return dt.table(names) + " " + " union all ".join(f"select '{n}' as filter, count(*) filter (where {c}) as rows from ft" for n, c in rows)


add("p17_default_counts", lambda s, p: preset_counts(s, p, filters.DEFAULT_FILTERS), preset_counts_sql(filters.DEFAULT_FILTERS))
add("p18_recommended_counts", lambda s, p: preset_counts(s, p, filters.RECOMMENDED_FILTERS), preset_counts_sql(filters.RECOMMENDED_FILTERS))
#: The features of the queries and all of the presets.
WIDE = [*FEATURES, *sorted({*defined(filters.DEFAULT_FILTERS), *defined(filters.RECOMMENDED_FILTERS)} - {*FEATURES})]
#: More features than the effects that are shown.
EFFECTS = [*WIDE, *(n for n in V1 if n in V3 and n not in WIDE)]


def wide_sql(names):
    return f"{dt.table(names)}, {dt.trades(SIGNAL)}, analysed as (select t.*, {', '.join('f.' + n for n in names)} from trades t join ft f on f.ticker = t.ticker and f.date = t.entry_date)"


add("p19_timing_filter", lambda s, p: fx.bars(s, p).where(filters.timing_ok()), BARS_SQL + "select * from bars where isodow(date) > 2 and month(date) <> 10", P5)
add("p20_date_slice", lambda s, p: filters.date_slice(fx.bars(s, p), "1997-01-01", "1998-06-30"), BARS_SQL + "select * from bars where date between '1997-01-01' and '1998-06-30'", P5)
add("p21_trade_search", lambda s, p: filters.filter_trades(run(s, p), "1996-01-01", "2000-12-31", -0.05, 0.08, "m").select("ticker", "entry_date", "return"),
    f"""{TR} select ticker, entry_date, "return" from trades where entry_date between '1996-01-01' and '2000-12-31' and "return" between -0.05 and 0.08 and ticker like '%M%'""", ['"return"'])
SPLIT = "split as (select *, case when date <= '1998-12-31' then 'train' when date <= '1999-12-31' then 'validation' when date <= '2001-06-30' then 'test' end as split from ft where date <= '2001-06-30')"


def split(spark, path):
    return scoring.split_by_date(ft(spark, path), "1998-12-31", "1999-12-31", "2001-06-30")


add("p22_date_split", lambda s, p: split(s, p).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("label_5d").alias("positives")),
    f"{FT}, {SPLIT} select split, count(*) as rows, cast(sum(label_5d) as bigint) as positives from split group by split")


def model_metrics(spark, path):
    """One row per single-feature rule (feature above 0) and how well it predicts the label."""
    d = ft(spark, path)
    made = []
    for f in IMP:
        hit = ((F.coalesce(F.col(f), F.lit(0.0)) > 0).cast("int") == F.col("label_5d")).cast("double")
        made.append(F.avg(hit).alias(f"accuracy_{len(made)}"))
    t = quality.long_result(d.agg(*made), IMP, ["accuracy"], "name")
    return t.select("name", "accuracy", (F.col("accuracy") / 2 + 0.25).alias("auc"), F.lit("v3").alias("feature_set"), F.lit(H).alias("horizon"))


MODELS = FT + ", models as (" + " union all ".join(
    f"select '{f}' as name, avg(cast(cast(coalesce({f}, 0) > 0 as integer) = label_5d as integer)) as accuracy from ft" for f in IMP) + ")"
add("p23_model_search", lambda s, p: scoring.search_models(model_metrics(s, p), "r", 0.2, 0.3, "v3", H),
    MODELS + f" select name, accuracy, accuracy / 2 + 0.25e0 as auc, 'v3' as feature_set, {H} as horizon from models where name like '%r%' and accuracy >= 0.2 and accuracy / 2 + 0.25 >= 0.3", ["accuracy", "auc"])


# ---- joins -------------------------------------------------------------------
def thin_market(spark, path):
    return fx.market(spark, path).where("day(date) % 5 <> 0")


add("j01_market_asof", lambda s, p: add_series(number_rows(price_columns(fx.bars(s, p))), thin_market(s, p).drop("ticker"), ["day"], "m").select("ticker", "date", "m"),
    f"with {BARS}, thin as (select * from market where day(date) % 5 <> 0) select b.ticker, b.date, t.close as m from bars b asof left join thin t on t.date <= b.date", ["m"])


def j02(spark, path):
    from dailybars.plans.runs import fill_forward
    b = number_rows(price_columns(fx.bars(spark, path)))
    m = thin_market(spark, path).select("date", F.col("close").alias("m"))
    return fill_forward(b.join(m, "date", "left"), "m", 1024).select("ticker", "date", "m")


add("j02_market_fill", j02, f"with {BARS}, thin as (select * from market where day(date) % 5 <> 0) select b.ticker, b.date, last_value(t.close ignore nulls) over (partition by b.ticker order by b.date rows unbounded preceding) as m from bars b left join thin t on t.date = b.date", ["m"])
MAP_SQL = "symbol_of(sector, symbol) as (values " + ", ".join(f"('{k}','{v}')" for k, v in SECTOR_SYMBOL.items()) + ")"
add("j03_sector_choice", lambda s, p: sector_symbols(fx.bars(s, p), fx.sector_map(s)),
    f"with {BARS}, {SECTORS_SQL}, {MAP_SQL}, f as (select ticker, min(date) as fd from bars group by ticker) select ticker, case when symbol = 'XLC' and fd < '2018-09-28' then 'XLK' when symbol = 'XLRE' and fd < '2015-10-07' then 'XLF' else symbol end as symbol from f join sectors using (ticker) join symbol_of using (sector)")


def j04(spark, path):
    sectors = fx.sector_bars(spark, path).where("day(date) % 7 <> 0").withColumnRenamed("ticker", "symbol")
    b = number_rows(price_columns(fx.bars(spark, path))).join(sector_symbols(fx.bars(spark, path), fx.sector_map(spark)), "ticker")
    return add_series(b, sectors, ["symbol", "day"], "s").select("ticker", "date", "symbol", "s")


SO = "so(ticker, symbol) as (values ('ECONOMY','XLP'),('SMALL','XLP'),('MEDIUM','XLI'),('STANDARD','XLI'),('LARGE','XLK'),('PROMO','XLF'))"
add("j04_sector_asof", j04, f"with {BARS}, {SO}, sb as (select symbol, date, arg_max(px, k) as close from x join so using (ticker) where day(date) % 7 <> 0 group by symbol, date) select b.ticker, b.date, b.symbol, sb.close as s from (select * from bars join so using (ticker)) b asof left join sb on sb.symbol = b.symbol and sb.date <= b.date", ["s"])
WEEK = "date + cast((12 - isodow(date)) % 7 as integer)"


def j05(spark, path):
    b = price_columns(fx.bars(spark, path))
    w = resample(b, week_label(), "week").select("ticker", F.col("date").alias("period"), F.col("c").alias("week_close"))
    return b.withColumn("period", last_friday()).join(w, ["ticker", "period"], "left").select("ticker", "date", "week_close")


add("j05_week_backjoin", j05, f"with {BARS}, w as (select ticker, {WEEK} as d, arg_max(close, date) as week_close from bars group by ticker, {WEEK}) select b.ticker, b.date, w.week_close from bars b asof left join w on w.ticker = b.ticker and w.d <= b.date", ["week_close"])


def j06(spark, path):
    sparse = ft(spark, path).where("day(date) % 3 <> 0")
    return scoring.entry_features(run(spark, path), sparse, ["rsi14", "roc10"]).select("ticker", "entry_date", "feature_date", "rsi14", "roc10", "pnl")


J6 = f"{TR}, sparse as (select * from ft where day(date) % 3 <> 0) select t.ticker, t.entry_date, s.date as feature_date, s.rsi14, s.roc10, t.pnl from trades t asof join sparse s on s.ticker = t.ticker and s.date <= t.entry_date"
add("j06_j07_entry_features", j06, J6, ["rsi14", "roc10", "pnl"])


def flawed(spark, path):
    made = run(spark, path)
    return made.withColumn("ticker", F.when(F.month("entry_date") == 1, "UNKNOWN").when(F.month("entry_date") == 2, "NONE").otherwise(F.col("ticker"))).withColumn(
        "entry_date", F.when(F.month("entry_date") != 3, F.col("entry_date")))


add("j07_entry_skips", lambda s, p: scoring.entry_skips(flawed(s, p), ft(s, p)),
    f"""{TR} select count(*) filter (where month(entry_date) > 3) as with_features, count(*) filter (where month(entry_date) = 2) as no_features,
    count(*) filter (where month(entry_date) = 1) as no_ticker, count(*) filter (where month(entry_date) = 3) as no_date from trades""")
add("j08_exact_entry_features", lambda s, p: scoring.exact_entry_features(run(s, p), ft(s, p).where("day(date) % 3 <> 0"), ["rsi14"]).select("ticker", "entry_date", "rsi14"),
    f"{TR}, sparse as (select * from ft where day(date) % 3 <> 0) select t.ticker, t.entry_date, s.rsi14 from trades t left join sparse s on s.ticker = t.ticker and s.date = t.entry_date", ["rsi14"])


def candidates(spark, path, stop="constant"):
    d = ft(spark, path).withColumn("entry_signal", F.coalesce(F.expr(SIGNAL), F.lit(False)))
    return trades.candidate_exits(d, "entry_signal", H, 1000.0, TARGET, STOP[stop])


add("j09_k04_forward_exits", lambda s, p: candidates(s, p).select(*trades.TRADE_FIELDS), f"{TR} select {TRADE_COLUMNS} from trades_all", TRADE_DOUBLES)
add("j10_new_dates", lambda s, p: incremental.new_dates(fx.bars(s, p), fx.bars(s, p).where("date < '2001-01-01'")).select("ticker", "date"), BARS_SQL + "select ticker, date from bars where date >= '2001-01-01'")


def j11(spark, path):
    b = fx.bars(spark, path)
    build = lambda bars, names: build_features(bars, names)
    stored = build(b, ["rsi14", "roc10"]).where("date < '2001-01-01' or ticker < 'M'")
    return incremental.merge_features(b, stored, ["rsi14", "roc10", "sma20_ratio"], build).select("ticker", "date", "close", "rsi14", "roc10", "sma20_ratio")


add("j11_incremental_merge", j11, FT + " select ticker, date, close, rsi14, roc10, sma20_ratio from ft", ["close", "rsi14", "roc10", "sma20_ratio"])
IMP2 = IMP_SQL + ", imp2 as (select feature, case when i < 0.005 then 0e0 else round(i, 6) end as importance from (" + " union all ".join(
    f"select '{f}' as feature, abs(corr({f}, cast(price_near_support as double))) as i from good" for f in IMP) + ")), " + RANKED + ", ranked2 as (select feature, importance, row_number() over (order by importance desc, feature) as rank from imp2)"
add("j12_ranking_join", lambda s, p: quality.joined_rankings(importances(s, p), importances(s, p, "price_near_support")),
    IMP2 + " select feature, cast(a.rank as integer) as rank_1, a.importance as importance_1, cast(b.rank as integer) as rank_2, b.importance as importance_2 from ranked a join ranked2 b using (feature)", ["importance_1", "importance_2"])

# ---- aggregations and reports -------------------------------------------------
add("b01_no_trades", lambda s, p: reports.trade_metrics(run(s, p).where("holding_days > 1000")).drop("date_range"),
    "select 0 as n_trades, 0e0 as win_rate, 0e0 as avg_return, 0e0 as total_pnl, 0e0 as avg_pnl, 0e0 as max_drawdown, 0e0 as sharpe_ratio, null::double as profit_factor, 0e0 as avg_holding_days, 0e0 as annual_return, 0 as max_concurrent_positions, 0e0 as max_capital_invested")
add("b01_metrics", lambda s, p: reports.trade_metrics(run(s, p)), f"{TR} select * from {dt.metrics()}", dt.METRIC_DOUBLES)
add("b02_concurrency", lambda s, p: reports.concurrent_positions(run(s, p)), f"{TR} select max_concurrent_positions from {dt.metrics()}")
FIXED = f"fixed as (select ticker, date as entry_date, open as entry_price, lead(date, {H}) over w as exit_date, lead(close, {H}) over w as exit_price, {SIGNAL} as sig from ft window w as (partition by ticker order by date)), fixed_trades as (select ticker, entry_date, entry_price, exit_date, exit_price, exit_price / entry_price - 1e0 as \"return\", (exit_price / entry_price - 1e0) * 1000e0 as pnl from fixed where sig and exit_price is not null)"


def fixed_trades(spark, path):
    return labels.backtest_signals(ft(spark, path).withColumn("sig", F.coalesce(F.expr(SIGNAL), F.lit(False))), "sig", H)


add("b03_simple_metrics", lambda s, p: reports.simple_metrics(fixed_trades(s, p)),
    f"""{FT}, {FIXED}, eq as (select *, sum(pnl) over (order by entry_date, ticker rows unbounded preceding) as e from fixed_trades), dd as (select *, max(e) over (order by entry_date, ticker rows unbounded preceding) - e as d from eq)
    select count(*) as n_trades, avg(cast("return" > 0 as integer)) as hit_rate, avg("return") as avg_return, sum(pnl) as total_pnl, avg(pnl) as avg_pnl, max(d) as max_drawdown from dd""",
    ["hit_rate", "avg_return", "total_pnl", "avg_pnl", "max_drawdown"])
add("b04_exit_reasons", lambda s, p: reports.exit_reasons(run(s, p)), f"{TR} select exit_reason, count(*) as trades, count(*) / sum(count(*)) over () as share from trades group by exit_reason", ["share"])
TL = f'{TR}, tl as (select *, "return" * 100 as pct from trades where exit_reason = \'time_limit\')'
add("b05_time_limit", lambda s, p: reports.time_limit_summary(run(s, p)),
    TL + " select count(*) as total, count(*) filter (where pct > 0) as wins, count(*) filter (where pct < 0) as losses, count(*) filter (where pct = 0) as breakeven, avg(pct) as avg_return, "
    + ", ".join(f"{fn}(pct) filter (where pct {op} 0) as {fn}_{side}" for side, op in (("won", ">"), ("lost", "<")) for fn in ("avg", "max", "min"))
    + ", quantile_cont(pct, 0.5) as median_return, quantile_cont(pct, 0.5) filter (where pct > 0) as median_won, quantile_cont(pct, 0.5) filter (where pct < 0) as median_lost from tl",
    ["avg_return", "avg_won", "max_won", "min_won", "avg_lost", "max_lost", "min_lost", "median_return", "median_won", "median_lost"])


def bucket_case(col, buckets, lower_open):
    parts = []
    for lo, hi, label in buckets:
        low = [] if lo is None else [f"{col} {'>' if lower_open else '>='} {lo}"]
        high = [] if hi is None else [f"{col} {'<=' if lower_open else '<'} {hi}"]
        parts.append(f"when {' and '.join(low + high)} then '{label}'")
    return "case " + " ".join(parts) + " end"


def bucket_sql(source, col, buckets, lower_open):
    return f"select * from (select {bucket_case(col, buckets, lower_open)} as bucket, count(*) as trades, count(*) * 100e0 / sum(count(*)) over () as pct from {source} where {col} is not null group by 1) where bucket is not null"


add("b05_return_buckets", lambda s, p: reports.bucketed(run(s, p).where("exit_reason = 'time_limit'"), "return", reports.RETURN_BUCKETS, True), TL + " " + bucket_sql("tl", '"return"', reports.RETURN_BUCKETS, True), ["pct"])
SWING = f"{FT}, {dt.trades(SIGNAL, 'swing_atr')}"
add("b06_stop_summary", lambda s, p: reports.stop_summary(run(s, p, "swing_atr")),
    SWING + " select avg(stop_loss_pct) as avg_stop_pct, min(stop_loss_pct) as min_stop_pct, max(stop_loss_pct) as max_stop_pct, count(*) filter (where used_swing_low) as trades_using_swing_low, count(*) filter (where not used_swing_low) as trades_using_fallback, avg(cast(used_swing_low as integer)) * 100 as swing_low_usage_pct, avg(swing_distance_pct) as avg_swing_distance_pct, min(swing_distance_pct) as min_swing_distance_pct, max(swing_distance_pct) as max_swing_distance_pct, avg(buffer_pct) as avg_buffer_pct from trades",
    ["avg_stop_pct", "min_stop_pct", "max_stop_pct", "swing_low_usage_pct", "avg_swing_distance_pct", "min_swing_distance_pct", "max_swing_distance_pct", "avg_buffer_pct"])
add("b06_stop_buckets", lambda s, p: reports.bucketed(run(s, p, "adaptive_atr"), "stop_loss_pct", reports.STOP_BUCKETS, False),
    f"{FT}, {dt.trades(SIGNAL, 'adaptive_atr')} " + bucket_sql("trades", "stop_loss_pct", reports.STOP_BUCKETS, False), ["pct"])


def effect_sql(first, second, names=FEATURES):
    return "eff as (select *, a - b as difference, (a - b) / nullif(sqrt((sa * sa + sb * sb) / 2), 0) as d from (" + " union all ".join(
        f"select '{f}' as feature, avg({f}) filter (where {first}) as a, avg({f}) filter (where {second}) as b, stddev_samp({f}) filter (where {first}) as sa, stddev_samp({f}) filter (where {second}) as sb from analysed" for f in names) + ") where sa > 0)"


STOPPED, WINNER, WINNER2 = "exit_reason = 'stop_loss'", '"return" > 0', "exit_reason <> 'stop_loss' and \"return\" > 0"
add("b07_stop_vs_winner", lambda s, p: reports.stop_vs_winner(analysed(s, p), FEATURES),
    f"{AN}, {effect_sql(STOPPED, WINNER)} select feature, a as stop_loss_mean, b as winner_mean, difference, d as cohens_d, abs(d) as abs_effect, case when abs(d) > 0.3 then 'Filter: ' || feature || case when a > b then ' < ' else ' > ' end || format('{{:.3f}}', a) end as recommendation from eff where d is not null",
    ["stop_loss_mean", "winner_mean", "difference", "cohens_d", "abs_effect"])
SUGGEST = "select feature, case when a > b then '<' else '>' end as operator, least(a, b) + abs(a - b) * 0.3e0 as value, abs(d) as effect_size, d as cohens_d, case when abs(d) > 0.5 then 'strong' when abs(d) >= 0.3 then 'moderate' else 'weak' end as category from eff where abs(d) >= {0}"
add("b08_stop_analysis", lambda s, p: reports.stop_analysis(analysed(s, p), FEATURES, 0.1), f"{AN}, {effect_sql(STOPPED, WINNER2)} " + SUGGEST.format(0.1), ["value", "effect_size", "cohens_d"])
add("b08_stop_counts", lambda s, p: reports.stop_counts(run(s, p)),
    f"""{TR} select count(*) as total_trades, count(*) filter (where {STOPPED}) as stop_loss_count, count(*) filter (where {WINNER}) as winning_count, count(*) filter (where exit_reason = 'target_reached') as target_count, count(*) filter (where {STOPPED}) / count(*) as stop_loss_rate,
    count(*) filter (where {STOPPED} and holding_days <= 1) as immediate_stop_count, count(*) filter (where {STOPPED} and holding_days <= 1) / nullif(count(*) filter (where {STOPPED}), 0) as immediate_stop_rate from trades""", ["stop_loss_rate", "immediate_stop_rate"])
add("b09_immediate_stops", lambda s, p: reports.immediate_stop_analysis(analysed(s, p), FEATURES), f"{AN}, {effect_sql('holding_days <= 1', WINNER2)} " + SUGGEST.format(0.2), ["value", "effect_size", "cohens_d"])
add("b10_timing_histogram", lambda s, p: reports.timing_histogram(run(s, p)),
    f"{TR}, h as (select 'weekday' as part, cast(isodow(entry_date) - 1 as integer) as value from trades where {STOPPED} union all select 'month', cast(month(entry_date) as integer) from trades where {STOPPED}) select part, value, count(*) as trades, count(*) * 100e0 / sum(count(*)) over (partition by part) as pct from h group by part, value", ["pct"])
add("b11_holding_statistics", lambda s, p: reports.holding_statistics(run(s, p)),
    f"{TR} select avg(holding_days) as mean_days, min(holding_days) as min_days, max(holding_days) as max_days, count(*) filter (where holding_days <= 1) as immediate, avg(cast(holding_days <= 1 as integer)) * 100 as immediate_pct, quantile_cont(holding_days, 0.5) as median_days from trades where {STOPPED}", ["mean_days", "immediate_pct", "median_days"])
DAYS = [(a, b, f"{a}-{b} days") for a, b in zip(reports.DAY_BINS, reports.DAY_BINS[1:])]
add("b11_holding_bins", lambda s, p: reports.holding_bins(run(s, p)), f"{TR}, st as (select * from trades where {STOPPED}) " + bucket_sql("st", "holding_days", DAYS, False), ["pct"])
add("b12_return_statistics", lambda s, p: reports.return_statistics(run(s, p)),
    f"""{TR}, st as (select "return" * 100 as pct from trades where {STOPPED}) select avg(pct) as mean, min(pct) as min, max(pct) as max, stddev_samp(pct) as std, count(*) filter (where pct between -8 and -7) as near_threshold, avg(cast(pct between -8 and -7 as integer)) * 100 as near_pct, quantile_cont(pct, 0.5) as median from st""",
    ["mean", "min", "max", "std", "near_pct", "median"])
BIG = "(lower(exit_reason) like '%stop_loss%' or \"return\" < -0.05)"
add("b13_filter_impact", lambda s, p: reports.filter_impact(analysed(s, p), MY_FILTERS),
    f"""{AN}, i as (select count(*) filter (where {STOPPED} and not ok) * 100e0 / count(*) filter (where {STOPPED}) as stop_loss_excluded_pct, count(*) filter (where {WINNER} and not ok) * 100e0 / count(*) filter (where {WINNER}) as winner_excluded_pct,
    count(*) filter (where {STOPPED} and ok) * 100e0 / count(*) filter (where ok) as estimated_new_sl_rate, count(*) filter (where ok) as estimated_total_trades, count(*) as total_trades_before, count(*) filter (where {STOPPED}) as stop_loss_count_before, count(*) filter (where {STOPPED} and ok) as stop_loss_count_after
    from (select *, {MY_SQL} as ok from analysed)) select *, concat_ws('; ', case when (total_trades_before - estimated_total_trades) * 100e0 / total_trades_before >= 50 then 'few trades left' end, case when winner_excluded_pct >= 20 then 'many winners excluded' end, case when estimated_total_trades = 0 then 'no trades left' end) as warnings from i""",
    ["stop_loss_excluded_pct", "winner_excluded_pct", "estimated_new_sl_rate"])


def impact_row(name, out):
    return (f"select '{name}' as filter, count(*) filter (where {out} and {WINNER}) as winners_excluded, count(*) filter (where {out} and {WINNER}) * 100e0 / count(*) filter (where {WINNER}) as winners_excluded_pct, "
            f"count(*) filter (where {out} and {BIG}) as stop_losses_excluded, count(*) filter (where {out} and {BIG}) * 100e0 / count(*) filter (where {BIG}) as stop_losses_excluded_pct, "
            f"count(*) filter (where {out}) as total_excluded, count(*) filter (where {out}) * 100e0 / count(*) as total_excluded_pct from analysed")


add("b14_impact_per_filter", lambda s, p: reports.impact_per_filter(analysed(s, p), MY_FILTERS),
    f"{AN} " + " union all ".join([impact_row(f, f"not coalesce({f} {op} {v}, false)") for f, op, v in MY_FILTERS if f in FEATURES] + [impact_row("combined", f"not {MY_SQL}")]),
    ["winners_excluded_pct", "stop_losses_excluded_pct", "total_excluded_pct"])


def kept_trades(name, ok):
    return f"select *, '{name}' as filter from analysed where {ok}"


MASKS = {"before": "true", **{f: f"coalesce({f} {op} {v}, false)" for f, op, v in MY_FILTERS if f in FEATURES}, "combined": MY_SQL}
FILTER_DOUBLES = ["remaining_pct", "win_rate", "avg_return", "total_pnl", "max_drawdown", "sharpe_ratio", "profit_factor", "annual_return"]
def trades_with_features(spark, path):
    features = ft(spark, path)
    t = written(trades.run_backtest(features, F.expr(SIGNAL), H, 1000.0, TARGET, STOP["constant"]).drop(*trades.STOP_FIELDS), "trades")
    return t.join(features.select("ticker", F.col("date").alias("entry_date"), *FEATURES), ["ticker", "entry_date"])


add("b14_filter_metrics", lambda s, p: reports.filter_metrics(trades_with_features(s, p), MY_FILTERS),
    f"{AN}, runs as ({' union all '.join(kept_trades(n, ok) for n, ok in MASKS.items())}), m as (select * from {dt.metrics('runs', 'filter')}) "
    "select filter, n_trades as remaining_trades, n_trades * 100e0 / (select count(*) from analysed) as remaining_pct, win_rate, avg_return, total_pnl, max_drawdown, sharpe_ratio, profit_factor, annual_return from m",
    FILTER_DOUBLES)


def two_runs(spark, path):
    base = run(spark, path).withColumn("run_id", F.lit("base"))
    return base.unionByName(run(spark, path, filters=MY_FILTERS).withColumn("run_id", F.lit("filtered")))


TWO = f"{FT}, {dt.trades(SIGNAL)}, {dt.trades(SIGNAL + ' and ' + MY_SQL, name='fewer')}, runs as (select *, 'base' as run_id from trades union all select *, 'filtered' from fewer)"
add("b15_side_by_side", lambda s, p: reports.side_by_side(two_runs(s, p), "run_id", "base", "filtered"),
    f"{TWO}, m as (select * from {dt.metrics('runs', 'run_id')}), u as (" + " union all ".join(f"select run_id, '{c}' as metric, cast({c} as double) as v from m" for c in reports.COMPARED)
    + ") select metric, max(v) filter (where run_id = 'base') as baseline, max(v) filter (where run_id = 'filtered') as filtered, max(v) filter (where run_id = 'filtered') - max(v) filter (where run_id = 'base') as change from u group by metric",
    ["baseline", "filtered", "change"])
WHOLE = {"default": filters.DEFAULT_FILTERS, "recommended": filters.RECOMMENDED_FILTERS, "mine": MY_FILTERS}
WHOLE_SQL = {n: " and ".join(f"coalesce({f} {op} {v}, false)" for f, op, v in preset if f in WIDE) for n, preset in WHOLE.items()}
add("b16_preset_comparison", lambda s, p: reports.preset_comparison(analysed(s, p, names=WIDE), WHOLE),
    f"{wide_sql(WIDE)}, pr as (" + " union all ".join(
        f"select '{n}' as preset, count(*) filter (where ok) as remaining_trades, count(*) filter (where not ok and {WINNER}) * 100e0 / count(*) filter (where {WINNER}) as winners_excluded_pct, count(*) filter (where not ok and {BIG}) * 100e0 / count(*) filter (where {BIG}) as stop_losses_excluded_pct, "
        f"coalesce(count(*) filter (where ok and {WINNER}) / nullif(count(*) filter (where ok), 0), 0) as win_rate from (select *, {c} as ok from analysed)" for n, c in WHOLE_SQL.items())
    + ") select *, winners_excluded_pct = min(winners_excluded_pct) over () as best_winners, stop_losses_excluded_pct = max(stop_losses_excluded_pct) over () as best_stops, win_rate = max(win_rate) over () as best_win_rate from pr",
    ["winners_excluded_pct", "stop_losses_excluded_pct", "win_rate"])
add("b17_run_comparison", lambda s, p: reports.compare_runs(two_runs(s, p), "run_id", 0.1), f"{TWO} select * from {dt.metrics('runs', 'run_id')} where win_rate >= 0.1", dt.METRIC_DOUBLES)
CAL = "cal as (select cast(unnest(generate_series(min(exit_date), max(exit_date), interval 1 day)) as date) as date from trades)"
add("b18_equity_curve", lambda s, p: reports.equity_curve(run(s, p)),
    f"""{TR}, {CAL}, f as (select exit_date as date, product(1 + "return") as f from trades group by exit_date), e as (select date, 10000e0 * product(f) over (order by date rows unbounded preceding) as equity from f) select c.date, e.equity from cal c asof join e on e.date <= c.date""", ["equity"])
add("b19_drawdown_curve", lambda s, p: reports.drawdown_curve(run(s, p)),
    f"""{TR}, {CAL}, eq as (select *, sum(pnl) over (order by {dt.ENTRY_ORDER} rows unbounded preceding) as e, row_number() over (order by {dt.ENTRY_ORDER}) as i from trades), dd as (select *, max(e) over (order by i rows unbounded preceding) - e as d from eq),
    l as (select exit_date as date, arg_max(e, i) as equity, arg_max(d, i) as drawdown from dd group by exit_date) select c.date, l.equity, l.drawdown from cal c asof join l on l.date <= c.date""", ["equity", "drawdown"])
add("b20_rolling_metrics", lambda s, p: reports.rolling_trade_metrics(run(s, p)),
    f"""{TR} select ticker, entry_date, exit_date, case when stddev_samp("return") over w > 0 then avg("return") over w / stddev_samp("return") over w * sqrt(252e0) else 0e0 end as rolling_sharpe, avg(cast("return" > 0 as integer)) over w * 100 as rolling_win_rate from trades window w as (order by {dt.ENTRY_ORDER} rows between 19 preceding and current row)""",
    ["rolling_sharpe", "rolling_win_rate"])
add("b21_return_histogram", lambda s, p: reports.return_histogram(run(s, p)),
    f"""{TR}, t as (select "return" * 100 as pct, min("return" * 100) over () as lo, max("return" * 100) over () as hi from trades) select cast(least(29, coalesce(floor((pct - lo) / nullif((hi - lo) / 30, 0)), 0)) as integer) as bin, count(*) as trades from t group by 1""")


def per_feature(select, names=FEATURES, source="ft"):
    return " union all ".join("select '" + f + "' as feature, " + select.replace("{f}", f) + f" from {source}" for f in names)


add("b22_feature_quality", lambda s, p: quality.feature_quality(ft(s, p), FEATURES),
    FT + " select feature, nan_rate, variance, std, hi - lo as range, coalesce(variance < 1e-10 or hi - lo < 1e-10, false) as is_constant, coalesce(variance < 1e-6 or hi - lo < 1e-6, false) as is_near_constant, nan_rate > 0.1 as has_high_nan from ("
    + per_feature("avg(cast({f} is null as integer)) as nan_rate, var_samp({f}) as variance, stddev_samp({f}) as std, min({f}) as lo, max({f}) as hi") + ")", ["nan_rate", "variance", "std", "range"])
add("b23_feature_validation", lambda s, p: quality.validate_features(ft(s, p), FEATURES),
    FT + " select feature, infinite, n - present as nulls, (n - present) * 100e0 / n > 50 as mostly_null, present > 1 and lo = hi as constant, infinite = 0 and not ((n - present) * 100e0 / n > 50) and not (present > 1 and lo = hi) as valid from ("
    + per_feature("count(*) as n, count(*) filter (where isinf({f})) as infinite, count({f}) as present, min({f}) as lo, max({f}) as hi") + ")")
MISSING = " + ".join(f"cast({f} is null as integer)" for f in FEATURES)
add("b24_sparse_rows", lambda s, p: quality.sparse_rows(ft(s, p), FEATURES),
    f"{FT} select count(*) as rows, count(*) filter (where {MISSING} > {len(FEATURES) / 2}) as sparse_rows, avg(cast({MISSING} > {len(FEATURES) / 2} as integer)) as share from ft", ["share"])
PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
CORR = f"{FT}, pairs as (" + " union all ".join(f"select '{a}' as feature_1, '{b}' as feature_2, corr({a}, {b}) as corr from ft" for a, b in PAIRS) + ")"
add("b25_correlations", lambda s, p: quality.correlations(ft(s, p), FEATURES), CORR + " select * from pairs", ["corr"])
add("b26_redundant_pairs", lambda s, p: quality.redundant_pairs(quality.correlations(ft(s, p), FEATURES), 0.4), CORR + " select * from pairs where abs(corr) >= 0.4", ["corr"])
TIER = "case when importance = 0 then 'zero' when importance < 0.0001 then 'very_low' when importance < 0.001 then 'low' when importance < 0.01 then 'medium' else 'high' end"
add("b27_importance_tiers", lambda s, p: quality.importance_tiers(importances(s, p)),
    f"{IMP_SQL}, {RANKED} select {TIER} as tier, count(*) as features, sum(pct) as importance_pct, (select sum(pct) from ranked where rank <= 20) as top_20_pct from ranked group by 1", ["importance_pct", "top_20_pct"])
add("b28_importance_table", lambda s, p: quality.importance_table(importances(s, p)), f"{IMP_SQL}, {RANKED} select feature, importance, cast(rank as integer) as rank, pct, cumulative_pct from ranked", ["importance", "pct", "cumulative_pct"])
add("b29_prune_zero", lambda s, p: quality.features_to_disable(importances(s, p).withColumn("importance", F.when(F.col("importance") >= 0.3, F.col("importance")).otherwise(0.0)), "drop_zero"),
    f"{IMP_SQL} select feature from imp where importance < 0.3")
add("b29_prune_weak", lambda s, p: quality.features_to_disable(importances(s, p), "drop_below_threshold", 0.5), f"{IMP_SQL} select feature from imp where importance < 0.5")
add("b29_keep_top", lambda s, p: quality.features_to_disable(importances(s, p), "keep_top_n", 5), f"{IMP_SQL}, {RANKED} select feature from ranked where rank > 5")
add("b29_prune_below", lambda s, p: quality.features_to_disable(importances(s, p), "drop_below_threshold", 0.2), f"{IMP_SQL} select feature from imp where importance < 0.2")


def b30(spark, path):
    data = ft(spark, path)
    return quality.pruning_recommendations(importances(spark, path), quality.redundant_pairs(quality.correlations(data, IMP), 0.4), quality.feature_quality(data, IMP, 0.002))


IMP_PAIRS = [(a, b) for i, a in enumerate(IMP) for b in IMP[i + 1:]]
add("b30_pruning", b30,
    f"{IMP_SQL}, pairs as (" + " union all ".join(f"select '{a}' as f1, '{b}' as f2, corr({a}, {b}) as r from ft" for a, b in IMP_PAIRS) + f"), q as ({per_feature('avg(cast({f} is null as integer)) as nan_rate, var_samp({f}) as variance, max({f}) - min({f}) as spread', IMP)}), "
    f"why as (select feature, case when importance = 0 then 'zero_importance' else 'very_low_importance' end as reason from imp where {TIER} in ('zero', 'very_low') union select case when a.importance > b.importance then f2 else f1 end, 'redundant' from pairs join imp a on a.feature = f1 join imp b on b.feature = f2 where abs(r) >= 0.4 "
    "union select feature, 'high_nan' from q where nan_rate > 0.002 union select feature, 'constant' from q where variance < 1e-10 or spread < 1e-10) select feature, string_agg(reason, ',' order by reason) as reasons from why group by feature")
add("b31_ranking_changes", lambda s, p: quality.ranking_changes(importances(s, p), importances(s, p, "price_near_support"), 2),
    IMP2 + ", pair as (select feature, a.rank as r1, b.rank as r2 from ranked a join ranked2 b using (feature)) select feature, cast(r1 as integer) as rank_1, cast(r2 as integer) as rank_2, cast(abs(r1 - r2) as integer) as moved, case when r2 < r1 then 'up' else 'down' end as direction, (select corr(r1, r2) from pair) as similarity from pair where abs(r1 - r2) >= 2", ["similarity"])
CHECKS = [(f"bad_{c}", f"{c} <= 0") for c in P5] + [("high_below_low", "high < low"), ("high_below_close", "high < close"), ("low_above_close", "low > close"), ("negative_volume", "volume < 0")]
add("b32_bar_checks", lambda s, p: clean.check_bars(clean.parse_rows(raw(s, p))), f"with {RAW_SQL} select ticker, " + ", ".join(f"count(*) filter (where {c}) as {n}" for n, c in CHECKS) + " from parsed group by ticker")
add("b33_gaps", lambda s, p: clean.find_gaps(cleaned(s, p)),
    f"with {RAW_SQL}, g as (select ticker, date, lag(date) over (partition by ticker order by date) as before from cleaned) select ticker, before as gap_start, date as gap_end, cast(date - before as integer) as days from g where date - before > 10")
add("b34_integrity", lambda s, p: clean.check_integrity(fx.lines(s, p).select("ticker", F.when(F.day("date") != 1, F.col("date")).alias("date"))),
    f"with {BARS}, d as (select ticker, case when day(date) <> 1 then date end as date from x) select ticker, cast(sum(case when date is null then n else 0 end) as bigint) as null_dates, cast(sum(case when date is not null then n - 1 else 0 end) as bigint) as duplicate_dates from (select ticker, date, count(*) as n from d group by ticker, date) group by ticker")
add("b35_cleaning_statistics", lambda s, p: clean.cleaning_statistics(raw(s, p)),
    f"with {RAW_SQL}, r as (select ticker, count(*) as rows_before from raw group by ticker), a as (select ticker, count(*) filter (where open > 0 and high > 0 and low > 0 and close > 0 and volume > 0) as rows_after, count(*) filter (where replaced) as volume_replaced from parsed group by ticker) select ticker, rows_before, rows_after, volume_replaced, rows_before - rows_after as rows_dropped, rows_after * 100e0 / rows_before as kept_pct from r join a using (ticker)", ["kept_pct"])
add("b36_most_nulls", lambda s, p: quality.most_nulls(ft(s, p), FEATURES), FT + " select feature, nulls from (" + per_feature("count(*) filter (where {f} is null) as nulls") + ") order by nulls desc, feature limit 5")
add("b37_column_profile", lambda s, p: quality.column_profile(ft(s, p).select("ticker", "date", "volume", "rsi14", "label_5d")),
    FT + " " + " union all ".join(f"select '{c}' as column, '{t}' as type, count({c}) as non_null, count(*) - count({c}) as nulls, max(date) as latest from ft" for c, t in (("ticker", "string"), ("date", "date"), ("volume", "bigint"), ("rsi14", "double"), ("label_5d", "int"))))
add("b38_feature_bounds", lambda s, p: quality.feature_bounds(ft(s, p), "volatility_21d"),
    FT + " select quantile_cont(volatility_21d, 0.5) as neutral, quantile_cont(volatility_21d, 0.01) as low, quantile_cont(volatility_21d, 0.99) as high, greatest(0.1e0, stddev_samp(volatility_21d) * 0.1e0) as increment from ft", ["neutral", "low", "high", "increment"])
SUMMARY = [n for block in ("1.2 returns", "1.6 volatility", "2.1 volume", "2.2 rsi", "5.2 average alignment", "10.4 single candles", "15 calendar") for n in V3.blocks[block]]
add("b39_feature_groups", lambda s, p: quality.feature_summary(ft(s, p, SUMMARY + ["rsi14"] * ("rsi14" not in SUMMARY)), CATEGORY),
    feature_sql(SUMMARY, "v3", tail="select category, count(*) as features, cast(sum(present) as bigint) as values from ("
                + " union all ".join(f"select '{CATEGORY[n]}' as category, count({n}) as present from feats" for n in SUMMARY) + ") group by category"))
add("b40_weekly_bars", lambda s, p: resample(price_columns(fx.bars(s, p)), week_label(), "week"),
    f"with {BARS} select ticker, {WEEK} as date, arg_max(close, date) as c, max(high) as h, min(low) as l, cast(sum(volume) as double) as vol from bars group by ticker, {WEEK}", ["c", "h", "l", "vol"])
add("b41_monthly_bars", lambda s, p: resample(price_columns(fx.bars(s, p)), F.last_day("date"), "month").select("ticker", "date", "c"),
    f"with {BARS} select ticker, last_day(date) as date, arg_max(close, date) as c from bars group by ticker, last_day(date)", ["c"])

# ---- windows over whole tables -------------------------------------------------
VIX = f"with {BARS}, v as (select date, close, close / lag(close) over w - 1 as pct_change, case when n >= 5 then avg(close) over w5 end as ma_5, case when n >= 10 then avg(close) over w10 end as ma_10, close - lag(close, 5) over w as momentum_5, case when n >= 20 then (close - avg(close) over w20) / nullif(stddev_samp(close) over w20, 0) end as zscore_20 from (select *, row_number() over (order by date) as n from market) window w as (order by date), w5 as (order by date rows 4 preceding), w10 as (order by date rows 9 preceding), w20 as (order by date rows 19 preceding)) select * from v where zscore_20 is not null and momentum_5 is not null"
add("w14_market_indicators", lambda s, p: clean.market_indicators(fx.market(s, p)), VIX, ["close", "pct_change", "ma_5", "ma_10", "momentum_5", "zscore_20"])
add("w15_split_adjustment", lambda s, p: clean.split_adjust(fx.splits(fx.bars(s, p))).select("ticker", "date", "close", "volume"),
    f"with {BARS}, f as (select *, product(case when ticker = 'ECONOMY' and date = '1998-06-01' then 2e0 when ticker = 'SMALL' and date = '1999-03-01' then 0.5e0 else 1e0 end) over (partition by ticker order by date rows unbounded preceding) as k from bars) select ticker, date, close * k as close, cast(round(volume / k) as bigint) as volume from f", ["close"])
add("w16_forward_label", lambda s, p: labels.label_future_return(fx.bars(s, p), 20, 0.10).select("ticker", "date", "label_20d"),
    BARS_SQL + "select ticker, date, case when max(high) over (partition by ticker order by date rows between 1 following and 20 following) / close - 1e0 > 0.10 then 1 else 0 end as label_20d from bars")
add("w17_forward_return", lambda s, p: labels.label_future_return_regression(fx.bars(s, p), 20).select("ticker", "date", "fwd_return_20d"),
    BARS_SQL + "select ticker, date, lead(close, 20) over (partition by ticker order by date) / close - 1e0 as fwd_return_20d from bars", ["fwd_return_20d"])
add("w18_fixed_horizon_trades", fixed_trades, f"{FT}, {FIXED} select * from fixed_trades", TRADE_DOUBLES)

# ---- backtest ------------------------------------------------------------------


def stop_frame(mode):
    def go(spark, path):
        d = ft(spark, path).where(SIGNAL)
        cols = stops.stop_columns(STOP[mode], d.columns, "open")
        return d.withColumns(cols).select("ticker", "date", *cols)
    return go


for mode, (pct, meta) in dt.STOPS.items():
    if mode != "half":
        add(f"k01_stop_{mode}", stop_frame(mode), f"{FT} select ticker, date, {pct} as stop_loss_pct{meta} from ft where {SIGNAL}", ["stop_loss_pct"] + (["swing_distance_pct", "buffer_pct"] if meta else []))
add("k02_stops_on_signals", lambda s, p: ft(s, p).withColumn("stop_loss_pct", F.when(F.expr(SIGNAL), stops.stop_columns(STOP["adaptive_atr"], ["atr14_normalized"])["stop_loss_pct"])).select("ticker", "date", "stop_loss_pct"),
    f"{FT} select ticker, date, case when {SIGNAL} then {dt.ADAPTIVE} end as stop_loss_pct from ft", ["stop_loss_pct"])
add("k03_default_stop", lambda s, p: run(s, p, "half").select("ticker", "entry_date", "stop_loss_pct", "exit_reason"),
    f"{FT}, {dt.trades(SIGNAL, 'half')} select ticker, entry_date, stop_loss_pct, exit_reason from trades", ["stop_loss_pct"])
add("k05_k06_trades", lambda s, p: run(s, p).drop("stop_loss_pct"), f"{TR} select {TRADE_COLUMNS} from trades", TRADE_DOUBLES)
add("k06_swing_trades", lambda s, p: run(s, p, "swing_atr"), f"{SWING} select * from trades", TRADE_DOUBLES + ["stop_loss_pct", "swing_distance_pct", "buffer_pct"])
add("k07_universe_backtest", lambda s, p: run(s, p, "adaptive_atr", filters=MY_FILTERS, start="1996-01-01", end="2000-12-31"),
    f"{FT}, {dt.trades(SIGNAL + ' and ' + MY_SQL, 'adaptive_atr', where='''date between '1996-01-01' and '2000-12-31' ''')} select * from trades", TRADE_DOUBLES + ["stop_loss_pct"])
add("k08_score_signal", lambda s, p: run(s, p, signal="probability >= 0.54").select("ticker", "entry_date", "return"),
    f"""{FT}, {dt.trades('probability >= 0.54')} select ticker, entry_date, "return" from trades""", ['"return"'])
add("k09_oracle_signal", lambda s, p: trades.run_backtest(ft(s, p), trades.oracle_signal(H), H, 1000.0, TARGET, STOP["constant"]).select("ticker", "entry_date", "return"),
    f"""{FT}, {dt.trades('label_5d = 1')} select ticker, entry_date, "return" from trades""", ['"return"'])
add("k10_rsi_signal", lambda s, p: trades.run_backtest(ft(s, p).withColumn("rsi", F.col("rsi14") * 60 + 40), trades.rsi_signal(), H, 1000.0, TARGET, STOP["constant"]).select("ticker", "entry_date", "return"),
    f"""{FT}, {dt.trades('rsi14 * 60 + 40 < 30')} select ticker, entry_date, "return" from trades""", ['"return"'])
add("k11_opportunities", lambda s, p: scoring.opportunities(ft(s, p), least=0.3, top=4, filters=[("volatility_21d", "<", 1.0)], stops=STOP["swing_atr"]),
    f"{FT}, {LATEST} select ticker, probability, close as current_price, {dt.STOPS['swing_atr'][0].replace('open', 'close')} as stop_loss_pct, date from latest where probability >= 0.3 and volatility_21d < 1 order by probability desc, ticker limit 4",
    ["probability", "current_price", "stop_loss_pct"])
add("k12_latest_rows", lambda s, p: scoring.latest_rows(ft(s, p)).select("ticker", "date", "close", "rsi14"), f"{FT}, {LATEST} select ticker, date, close, rsi14 from latest", ["close", "rsi14"])

# ---- scoring and models ----------------------------------------------------------
add("f01_class_weight", lambda s, p: scoring.class_weight(split(s, p), "label_5d", 2.0),
    f"{FT}, {SPLIT} select count(*) filter (where label_5d = 1) as positives, count(*) filter (where label_5d = 0) as negatives, count(*) filter (where label_5d = 0) / count(*) filter (where label_5d = 1) * 2e0 as weight from split where split = 'train'", ["weight"])
add("f02_majority", lambda s, p: scoring.majority_baseline(split(s, p), "label_5d"),
    f"{FT}, {SPLIT}, top as (select label_5d as predicted from split where split = 'train' group by 1 order by count(*) desc, 1 limit 1) select split, max(predicted) as predicted, count(*) as rows, avg(cast(label_5d = predicted as integer)) as accuracy, 0.5e0 as auc from split, top group by split", ["accuracy", "auc"])
SCORED = f"{FT}, scored as (select label_5d as y, probability as p from ft where probability is not null)"
CURVE = f"""{SCORED}, by_p as (select p, sum(y) as pos, count(*) as n from scored group by p), cum as (select *, sum(pos) over (order by p desc rows unbounded preceding) as tp, sum(n) over (order by p desc rows unbounded preceding) as fl, sum(pos) over () as np, sum(n) over () as nt from by_p),
curve as (select *, tp / fl as pr, coalesce(tp / nullif(np, 0), 0) as rc, 0 as closing from cum), points as (select *, 2 * pr * rc / (pr + rc + 1e-10) as f1 from curve union all by name select * replace (1e0 as pr, 0e0 as rc, 1 as closing), 0e0 as f1 from curve where p = (select max(p) from curve))"""


def scored(spark, path):
    return ft(spark, path).where("probability is not null")


add("f06_evaluation", lambda s, p: scoring.evaluate(scored(s, p), "label_5d", "probability", 0.55),
    f"""{CURVE}, c as (select count(*) filter (where p >= 0.55 and y = 1) as tp, count(*) filter (where p >= 0.55 and y = 0) as fp, count(*) filter (where p < 0.55 and y = 1) as fn, count(*) filter (where p < 0.55 and y = 0) as tn from scored),
    a as (select sum((n - pos) * (tp + tp - pos) / 2) / max(np * (nt - np)) as roc_auc, sum(pr * pos / np) as average_precision from curve)
    select roc_auc, average_precision, 2e0 * tp / (2 * tp + fp + fn) as f1_score, tp / (tp + fp) as precision, tp / (tp + fn) as recall, tn / (tn + fp) as specificity, (tp + tn) / (tp + fp + fn + tn) as accuracy, tp, fp, fn, tn from c, a""",
    ["roc_auc", "average_precision", "f1_score", "precision", "recall", "specificity", "accuracy"])
PICK = """ select p as optimal_threshold, pr as precision, rc as recall, f1 as f1_score, cast(nt - np - (fl - tp) as bigint) as true_negatives, cast(fl - tp as bigint) as false_positives, cast(np - tp as bigint) as false_negatives, cast(tp as bigint) as true_positives, cast(nt as bigint) as total_predictions, cast(fl as bigint) as positive_predictions, fl / nt as positive_rate from points order by {0}, p, closing limit 1"""
PICK_DOUBLES = ["optimal_threshold", "precision", "recall", "f1_score", "positive_rate"]
add("f07_best_f1", lambda s, p: scoring.find_threshold(scored(s, p), "label_5d", "probability"), CURVE + PICK.format("f1 desc"), PICK_DOUBLES)
add("f07_best_precision", lambda s, p: scoring.find_threshold(scored(s, p), "label_5d", "probability", best="precision"), CURVE + PICK.format("case when rc >= 0.3 then 0 else 1 end, case when rc >= 0.3 then -pr else -f1 end"), PICK_DOUBLES)
add("f07_target_precision", lambda s, p: scoring.find_threshold(scored(s, p), "label_5d", "probability", target_precision=0.3), CURVE + PICK.format("abs(pr - 0.3)"), PICK_DOUBLES)
add("f07_target_recall", lambda s, p: scoring.find_threshold(scored(s, p), "label_5d", "probability", target_recall=0.5), CURVE + PICK.format("abs(rc - 0.5)"), PICK_DOUBLES)
add("f08_threshold_sweep", lambda s, p: scoring.threshold_sweep(scored(s, p), "label_5d", "probability"),
    f"""{SCORED}, th as (select round(0.10e0 + 0.05e0 * i, 2) as t from range(17) r(i)), c as (select t, count(*) filter (where p >= t and y = 1) as tp, count(*) filter (where p >= t and y = 0) as fp, count(*) filter (where p < t and y = 1) as fn, count(*) as n from th, scored group by t)
    select t as threshold, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1_score, tp + fp as positive_predictions, (tp + fp) / n as positive_rate from c""",
    ["threshold", "precision", "recall", "f1_score", "positive_rate"])
add("f09_label_report", lambda s, p: quality.label_report(ft(s, p), "label_5d"),
    f"{FT} select count(*) as rows, sum(label_5d)::bigint as positives, avg(label_5d) as rate, (count(*) - sum(label_5d)) / sum(label_5d) as imbalance, case when avg(label_5d) > 0.5 then 'more than half positive' when avg(label_5d) < 0.01 then 'very rare' when avg(label_5d) > 0.2 then 'high share' else 'none' end as alarm from ft", ["rate", "imbalance"])
add("f10_stratified_sample", lambda s, p: quality.stratified_sample(ft(s, p).select("ticker", "date", "label_5d").where("label_5d is not null"), "label_5d", 2000),
    f"""{FT}, l as (select ticker, date, label_5d from ft where label_5d is not null), r as (select *, row_number() over (partition by label_5d order by md5(ticker || '|' || cast(date as varchar) || '|42'), ticker, date) as nr, count(*) over (partition by label_5d) as c, count(*) over () as n from l)
    select ticker, date, label_5d from r where nr <= floor(2000 * c / n + 0.5)""")
X = ["rsi14", "atr14_normalized", "close_position_in_range", "volatility_21d", "relative_volume", "roc10"]


def matrix(spark, path, part):
    d = models.weighted(scoring.prepare_matrix(split(spark, path).select("ticker", "date", "split", "label_5d", *X), X), "label_5d")
    return d.where(F.col("split") == part)


def f03(spark, path):
    m = models.logistic_baseline(matrix(spark, path, "train"), X, "label_5d")
    return scoring.evaluate(models.with_probability(m.transform(matrix(spark, path, "test"))), "label_5d", "score")


def f04(spark, path):
    train = matrix(spark, path, "train").withColumn("is_validation", F.lit(False)).unionByName(matrix(spark, path, "validation").withColumn("is_validation", F.lit(True)))
    m = models.boosted(train, X, "label_5d")
    return scoring.evaluate(models.with_probability(m.transform(matrix(spark, path, "test"))), "label_5d", "score")


def f05(spark, path):
    found = models.random_search(matrix(spark, path, "train"), X, "label_5d", by_time=True)  # 20 draws, 3 folds
    return spark.createDataFrame([(str(sorted(p.items())), a) for p, a in found], "parameters string, auc double")


def f11(spark, path):
    m = models.logistic_baseline(matrix(spark, path, "train"), X, "label_5d")
    score = lambda d: models.with_probability(m.transform(d))
    return quality.attribution_ranking(models.permutation_importance(score, matrix(spark, path, "test"), X, "label_5d"))


def f03_gradient(spark, path):
    train = matrix(spark, path, "train")
    g = models.logistic_gradient(models.logistic_baseline(train, X, "label_5d"), train, X, "label_5d")
    return g.select("feature", F.round(F.abs("gradient"), 3).alias("gradient"))


def f04_losses(spark, path):
    train = matrix(spark, path, "train")
    losses = models.losses_by_tree(models.boosted(train, X, "label_5d", trees=12), train, "label_5d")
    return spark.createDataFrame([(len(losses), all(a > b for a, b in zip(losses, losses[1:])))], "trees int, falls boolean")


def f05_plan(spark, path):
    """Drawn parameters with the sizes of their folds."""
    table = models.with_folds(matrix(spark, path, "train").select("ticker", "date"), 3, by_time=True)
    sizes = [[d.count() for d in models.fold_parts(table, k, True)] for k in range(3)]
    return spark.createDataFrame([(i, str(sorted(p.items())), k, *sizes[k]) for i, p in enumerate(models.draws()) for k in range(3)],
                                 "draw int, parameters string, fold int, train_rows bigint, validation_rows bigint")


LINEAR = "round(0.4e0 * volatility_21d - 0.9e0 * rsi14 + 0.3e0 * close_position_in_range - 2e0 * atr14_normalized + 0.05e0 * relative_volume - 0.5e0 * roc10 + 1.3e-8, 6)"


def f11_linear(spark, path):
    data = ft(spark, path).where("label_5d is not null").select("ticker", "date", "label_5d", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in X])
    return quality.attribution_ranking(models.permutation_importance(lambda d: d.withColumn("score", F.expr(LINEAR)), data, X, "label_5d"), 3)


def k08_model(spark, path):
    features = ft(spark, path).drop("probability")
    fitted = models.line(features.where("date < '1996-01-01' and label_5d is not null"), "volatility_21d", "label_5d")
    return trades.run_backtest(models.line_probability(features, fitted, "volatility_21d"), F.expr("probability >= 0.1 and date >= '1996-01-01'"), H, 1000.0, TARGET, STOP["constant"])


add("f03_logistic", f03)
add("f04_boosted_trees", f04)
add("f05_random_search", f05)
add("f11_permutation_importance", f11)
PLAN = ", ".join("({}, '{}')".format(i, str(sorted(d.items())).replace("'", "''")) for i, d in enumerate(models.draws()))
add("f05_search_plan", f05_plan,
    f"""{FT}, {SPLIT}, days as (select date, ntile(4) over (order by date) - 1 as part from (select distinct date from split where split = 'train')),
    r as (select part, count(*) as n from split join days using (date) where split = 'train' group by part),
    sizes as (select k, cast(sum(n) filter (where part <= k) as bigint) as train_rows, cast(sum(n) filter (where part = k + 1) as bigint) as validation_rows from r, (values (0), (1), (2)) t(k) group by k),
    plan(draw, parameters) as (values {PLAN}) select draw, parameters, k as fold, train_rows, validation_rows from plan, sizes""")
VARIANTS = " union all ".join(f"select '{v}' as variant, y, {LINEAR} as s from (select y, " + ", ".join(f"{'other_' if c == v else ''}{c} as {c}" for c in X) + " from pr)" for v in ["", *X])
F11_ORDER = "row_number() over (order by md5(ticker || '|' || cast(date as varchar) || '|{}'), ticker, date) as pos"
add("f11_linear_ranking", f11_linear,
    f"""{FT}, plain as (select ticker, date, label_5d as y, {', '.join(f'coalesce({c}, 0) as {c}' for c in X)} from ft where label_5d is not null),
    a as (select *, {F11_ORDER.format(42)} from plain), b as (select {', '.join(f'{c} as other_{c}' for c in X)}, {F11_ORDER.format(43)} from plain),
    pr as (select * from a join b using (pos)), sc as ({VARIANTS}),
    g as (select variant, s, count(*) filter (where y = 1) as ones, count(*) filter (where y = 0) as zeros from sc group by variant, s),
    r as (select variant, sum(ones * (upto - zeros / 2e0)) / (sum(ones) * sum(zeros)) as auc from (select *, sum(zeros) over (partition by variant order by s rows unbounded preceding) as upto from g) group by variant),
    imp as (select variant as feature, greatest((select auc from r where variant = '') - auc, 0e0) as importance from r where variant <> ''), {RANKED}
    select feature, importance, cast(rank as integer) as rank, pct, cumulative_pct, (select sum(pct) from ranked where rank <= 3) as top_pct from ranked""",
    ["importance", "pct", "cumulative_pct", "top_pct"])
add("k08_model_signal", lambda s, p: k08_model(s, p).select("ticker", "entry_date", "return"),
    f"""{FT}, fit as (select regr_slope(cast(label_5d as double), volatility_21d) as s, regr_intercept(cast(label_5d as double), volatility_21d) as i from ft where date < '1996-01-01' and label_5d is not null),
    model as (select ft.* exclude (probability), round(greatest(0e0, least(1e0, i + s * volatility_21d)) + 1.3e-8, 4) as probability from ft, fit),
    {dt.trades("probability >= 0.1 and date >= '1996-01-01'", source="model")} select ticker, entry_date, "return" from trades""", ['"return"'])


def failing(spark, path):
    """A feature that cannot be built is a null column and an entry in the list."""
    issues = []
    out = build_features(fx.bars(spark, path), ["roc10", "no_such_feature"], issues=issues)
    return out.select("ticker", "date", "roc10", "no_such_feature", F.lit(len(issues)).alias("issues"), F.lit(issues[0][0]).alias("issue"))


add("x04_failing_feature", failing, feature_sql(["roc10"], tail="select ticker, date, roc10, cast(null as double) as no_such_feature, 1 as issues, 'no_such_feature' as issue from feats"), ["roc10"])
add("f03_gradient", f03_gradient, "select unnest([" + ", ".join(f"'{n}'" for n in [*X, "intercept"]) + "]) as feature, 0e0 as gradient")
add("f04_losses", f04_losses, "select 12 as trees, true as falls")

# ---- sorts and sets -----------------------------------------------------------------
add("s01_ticker_order", lambda s, p: number_rows(fx.bars(s, p)).select("ticker", "date", "rn", "n_rows"),
    BARS_SQL + "select ticker, date, row_number() over (partition by ticker order by date) as rn, count(*) over (partition by ticker) as n_rows from bars")
add("s02_top_by_score", lambda s, p: ft(s, p).orderBy(F.col("probability").desc(), "ticker", "date").limit(10).select("ticker", "date", "probability"),
    FT + " select ticker, date, probability from ft order by probability desc nulls last, ticker, date limit 10", ["probability"])
add("s03_top_effects", lambda s, p: reports.stop_vs_winner(analysed(s, p, names=EFFECTS), EFFECTS).orderBy(F.col("abs_effect").desc()).limit(20).select("feature"),
    f"{wide_sql(EFFECTS)}, {effect_sql(STOPPED, WINNER, EFFECTS)} select feature from eff where d is not null order by abs(d) desc limit 20")
add("s04_s05_top_importances", lambda s, p: quality.importance_table(importances(s, p)).where("rank <= 5").select("feature", "rank"),
    f"{IMP_SQL}, {RANKED} select feature, cast(rank as integer) as rank from ranked where rank <= 5")
add("s06_exit_order", lambda s, p: reports.equity_path(run(s, p)).select("ticker", "entry_date", F.col("pos").cast("bigint").alias("pos"), "equity", "drawdown"),
    f"{TR}, eq as (select *, row_number() over (order by {dt.ENTRY_ORDER}) as pos, sum(pnl) over (order by {dt.ENTRY_ORDER} rows unbounded preceding) as equity from trades) select ticker, entry_date, pos, equity, max(equity) over (order by pos rows unbounded preceding) - equity as drawdown from eq", ["equity", "drawdown"])
add("s07_preview", lambda s, p: quality.preview(fx.bars(s, p)).unionByName(quality.preview(fx.bars(s, p), last=True)),
    f"with {BARS} select * from (select * from bars order by date, ticker limit 5) union all select * from (select * from bars order by date desc, ticker desc limit 5)", P5)
add("u01_union", lambda s, p: fx.bars(s, p).unionByName(fx.market(s, p)).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")),
    BARS_SQL + "select ticker, count(*) as rows from bars group by ticker union all select 'SPY', count(*) from market")
add("u02_distinct_rows", lambda s, p: raw(s, p).dropDuplicates().groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")),
    f"with {RAW_SQL} select ticker, count(*) as rows from (select distinct * from raw) group by ticker")


def versions(spark, path):
    b = fx.bars(spark, path).select("ticker", "date", "close")
    return b.withColumn("v", F.lit(1)).unionByName(b.where("day(date) % 2 = 0").withColumn("close", F.col("close") + 1).withColumn("v", F.lit(2)))


add("u03_keep_last", lambda s, p: clean.one_per_date(versions(s, p), "last", "v"), BARS_SQL + "select ticker, date, close + case when day(date) % 2 = 0 then 1 else 0 end as close from bars", ["close"])
add("u03_keep_first", lambda s, p: clean.one_per_date(versions(s, p), "first", "v"), BARS_SQL + "select ticker, date, close from bars", ["close"])
add("u04_difference", lambda s, p: incremental.new_dates(fx.bars(s, p), fx.bars(s, p).where("ticker <> 'SMALL'")).select("ticker", "date"), BARS_SQL + "select ticker, date from bars where ticker = 'SMALL'")
add("u05_intersection", lambda s, p: incremental.common_dates(fx.bars(s, p), fx.bars(s, p).where("month(date) = 2")).select("ticker", "date"), BARS_SQL + "select ticker, date from bars where month(date) = 2")
add("u06_reasons", lambda s, p: b30(s, p).select("feature", F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("features")),
    f"select reason, count(*) as features from (select feature, unnest(string_split(reasons, ',')) as reason from ({SQL['b30_pruning']})) group by reason")
for whole, name in (("p15_latest_all_filters", "p15_latest_filters"), ("b16_whole_presets", "b16_preset_comparison"), ("s03_top_20_effects", "s03_top_effects")):
    QUERIES[whole], SQL[whole] = QUERIES[name], SQL[name]  # names under which these ran before
