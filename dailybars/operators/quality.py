"""Feature quality, redundancy, importance and pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.plans.ordered import exact_quantiles, with_totals


def long_result(wide: DataFrame, features, fields, key: str = "feature") -> DataFrame:
    """One-row aggregate with columns <field>_<i> to one row per feature."""
    rows = F.array(*[F.struct(F.lit(f).alias(key), *[F.col(f"{c}_{i}").alias(c) for c in fields]) for i, f in enumerate(features)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def measure(df: DataFrame, features, **aggregates) -> DataFrame:
    """Aggregates of every feature in one pass, as one row per feature."""
    wide = df.agg(*[fn(F.col(f)).alias(f"{name}_{i}") for i, f in enumerate(features) for name, fn in aggregates.items()])
    return long_result(wide, features, list(aggregates))


def null_share(c):
    return F.avg(c.isNull().cast("double"))


def feature_quality(df: DataFrame, features, high_null: float = 0.10) -> DataFrame:
    t = measure(df, features, nan_rate=null_share, variance=F.var_samp, std=F.stddev_samp, low=F.min, high=F.max)
    spread = F.col("high") - F.col("low")
    flat = lambda limit: F.coalesce((F.col("variance") < limit) | (spread < limit), F.lit(False))
    return t.select("feature", "nan_rate", "variance", "std", spread.alias("range"), flat(1e-10).alias("is_constant"),
                    flat(1e-6).alias("is_near_constant"), (F.col("nan_rate") > high_null).alias("has_high_nan"))


def validate_features(df: DataFrame, features) -> DataFrame:
    """Infinite values, more than half null, or a single value."""
    t = measure(df, features, n=lambda c: F.count(F.lit(1)), infinite=lambda c: F.count(F.when(F.abs(c) == float("inf"), 1)),
                present=F.count, low=F.min, high=F.max)
    nulls = F.col("n") - F.col("present")
    constant = (F.col("present") > 1) & (F.col("low") == F.col("high"))
    mostly = F.coalesce(F.try_divide(nulls * 100.0, F.col("n")), F.lit(0.0)) > 50
    return t.select("feature", "infinite", nulls.alias("nulls"), mostly.alias("mostly_null"), constant.alias("constant"),
                    ((F.col("infinite") == 0) & ~mostly & ~constant).alias("valid"))


def sparse_rows(df: DataFrame, features) -> DataFrame:
    """Rows in which more than half of the features are null, and their share."""
    missing = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0))
    sparse = missing > len(features) / 2
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(sparse, 1)).alias("sparse_rows"),
                  F.avg(sparse.cast("double")).alias("share"))


def correlations(df: DataFrame, features) -> DataFrame:
    """Pearson correlation of every feature pair i < j over rows where both are present.

    Each task adds up small matrices of products over its own rows; only their
    sums per pair are shuffled, however many rows there are.
    """
    features = list(features)
    k = len(features)
    centre = df.agg(*[F.avg(f).alias(f) for f in features]).first()  # one number per feature
    centre = np.array([centre[f] if centre[f] is not None else 0.0 for f in features], dtype=float)
    upper = np.triu_indices(k, 1)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums = [m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x]
            totals = sums if totals is None else [a + b for a, b in zip(totals, sums)]
        if totals is not None:
            yield pd.DataFrame({"i": upper[0], "j": upper[1],
                                **{n: t[upper] for n, t in zip(("n", "x", "y", "xx", "yy", "xy"), totals)}})

    parts = df.select(*[F.col(f).cast("double") for f in features]).mapInPandas(
        products, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    c = F.col
    cov = c("xy") - F.try_divide(c("x") * c("y"), c("n"))
    vx, vy = c("xx") - F.try_divide(c("x") * c("x"), c("n")), c("yy") - F.try_divide(c("y") * c("y"), c("n"))
    name = F.array(*[F.lit(f) for f in features])
    return s.select(F.get(name, c("i")).alias("feature_1"), F.get(name, c("j")).alias("feature_2"),
                    F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("corr"))


def redundant_pairs(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    return pairs.where(F.abs("corr") >= threshold).orderBy(F.abs("corr").desc(), "feature_1", "feature_2")


# Importance tiers.
HIGH, MEDIUM, LOW = 0.01, 0.001, 0.0001


def tier():
    i = F.col("importance")
    return (F.when(i == 0, "zero").when(i < LOW, "very_low").when(i < MEDIUM, "low").when(i < HIGH, "medium").otherwise("high"))


def importance_table(importances: DataFrame) -> DataFrame:
    """Rank, percent and cumulative percent (one row per feature, a bounded list)."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
    whole = F.sum("importance").over(W.partitionBy(F.lit(0)))
    upto = F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, 0))
    pct = lambda x: F.coalesce(F.try_divide(x * 100.0, whole), F.lit(0.0))
    return importances.select("feature", "importance", F.row_number().over(order).alias("rank"),
                              pct(F.col("importance")).alias("pct"), pct(upto).alias("cumulative_pct"))


def importance_tiers(importances: DataFrame) -> DataFrame:
    """Features and share of importance per tier, and the share of the twenty strongest."""
    ranked = importance_table(importances).withColumn("tier", tier())
    top = ranked.agg(F.sum(F.when(F.col("rank") <= 20, F.col("pct"))).alias("top_20_pct"))
    return ranked.groupBy("tier").agg(F.count(F.lit(1)).alias("features"), F.sum("pct").alias("importance_pct")).crossJoin(top)


def features_to_disable(importances: DataFrame, rule: str, value: float = 0) -> DataFrame:
    """drop_zero, keep_top_n or drop_below_threshold."""
    if rule == "drop_zero":
        return importances.where(F.col("importance") < 1e-10).select("feature")
    if rule == "keep_top_n":
        return importance_table(importances).where(F.col("rank") > int(value)).select("feature")
    if rule == "drop_below_threshold":
        return importances.where(F.col("importance") < value).select("feature")
    raise ValueError(f"unknown rule {rule}")


def pruning_recommendations(importances: DataFrame, pairs: DataFrame, quality: DataFrame) -> DataFrame:
    """Features to remove with their reasons: no or very low importance, the weaker of a redundant pair, nulls, constants."""
    weak = importances.withColumn("t", tier()).where("t in ('zero', 'very_low')").select(
        "feature", F.when(F.col("t") == "zero", "zero_importance").otherwise("very_low_importance").alias("reason"))
    imp = lambda side: importances.select(F.col("feature").alias(f"feature_{side}"), F.col("importance").alias(f"imp_{side}"))
    both = pairs.join(imp(1), "feature_1", "left").join(imp(2), "feature_2", "left").na.fill(0.0, ["imp_1", "imp_2"])
    weaker = both.select(F.when(F.col("imp_1") > F.col("imp_2"), F.col("feature_2")).otherwise(F.col("feature_1")).alias("feature"),
                         F.lit("redundant").alias("reason"))
    flagged = lambda flag, reason: quality.where(flag).select("feature", F.lit(reason).alias("reason"))
    union = weak.unionByName(weaker).unionByName(flagged("has_high_nan", "high_nan")).unionByName(flagged("is_constant", "constant"))
    return union.distinct().groupBy("feature").agg(F.concat_ws(",", F.sort_array(F.collect_set("reason"))).alias("reasons"))


def joined_rankings(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two importance tables side by side, one row per common feature."""
    side = lambda t, n: importance_table(t).select("feature", F.col("rank").alias(f"rank_{n}"), F.col("importance").alias(f"importance_{n}"))
    return side(one, 1).join(side(two, 2), "feature")


def ranking_changes(one: DataFrame, two: DataFrame, least: int = 5) -> DataFrame:
    """Features whose rank moved by at least ``least``, and the rank correlation of the two lists."""
    both = joined_rankings(one, two)
    a, b = F.col("rank_1").cast("double"), F.col("rank_2").cast("double")
    rho = both.agg(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("similarity"))
    moved = F.abs(F.col("rank_1") - F.col("rank_2"))
    return (both.where(moved >= least).select("feature", "rank_1", "rank_2", moved.alias("moved"),
                                              F.when(F.col("rank_2") < F.col("rank_1"), "up").otherwise("down").alias("direction"))
            .crossJoin(rho))


def most_nulls(df: DataFrame, features, n: int = 5) -> DataFrame:
    t = measure(df, features, nulls=lambda c: F.count(F.when(c.isNull(), 1)))
    return t.orderBy(F.col("nulls").desc(), "feature").limit(n)


def column_profile(df: DataFrame, date: str = "date") -> DataFrame:
    """Type, present and null counts of every column, and the latest date."""
    t = measure(df, df.columns, non_null=F.count, nulls=lambda c: F.count(F.when(c.isNull(), 1)))
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    latest = df.agg(F.max(date).alias("latest"))
    return t.select(F.col("feature").alias("column"), types[F.col("feature")].alias("type"), "non_null", "nulls").crossJoin(latest)


def table_shape(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows, columns and date range of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def feature_bounds(df: DataFrame, feature: str, key=("ticker", "date")) -> DataFrame:
    """Median, step (a tenth of the deviation, at least 0.1) and the 1st and 99th percentile."""
    q = exact_quantiles(df, feature, {"neutral": 0.5, "low": 0.01, "high": 0.99}, unique=key)
    step = df.agg(F.greatest(F.lit(0.1), F.stddev_samp(feature) * 0.1).alias("increment"))
    return q.crossJoin(step)


def label_report(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives, their share, negatives per positive and an alarm for unusual shares."""
    pos, n = F.count(F.when(F.col(label) == 1, 1)), F.count(label)
    rate = F.coalesce(F.try_divide(pos * 1.0, n), F.lit(0.0))
    alarm = (F.when(rate > 0.5, "more than half positive").when(rate < 0.01, "very rare")
             .when(rate > 0.2, "high share").otherwise("none"))
    return df.agg(n.alias("rows"), pos.alias("positives"), rate.alias("rate"),
                  F.try_divide((n - pos) * 1.0, pos).alias("imbalance"), alarm.alias("alarm"))


def preview(df: DataFrame, n: int = 5, last: bool = False) -> DataFrame:
    """First or last rows by date and ticker."""
    order = [F.col("date").desc(), F.col("ticker").desc()] if last else ["date", "ticker"]
    return df.orderBy(*order).limit(n)


def stratified_sample(df: DataFrame, label: str, rows: int, seed: int = 42, keys=("ticker", "date")) -> DataFrame:
    """``rows`` rows with the class shares kept (rounded per class), first in a seeded hash order; all if there are fewer."""
    drawn = df.withColumn("drawn", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))
    shares = df.groupBy(label).agg(F.count(F.lit(1)).alias("size")).withColumn("whole", F.sum("size").over(W.partitionBy(F.lit(0))))  # one row a class
    quota = shares.select(F.col(label).alias("class"), F.least("size", F.floor(F.lit(rows) * F.col("size") / F.col("whole") + 0.5)).alias("quota"))
    placed = with_totals(drawn, ["drawn", *keys], [label])
    return placed.join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("class"))).where(F.col("pos") <= F.col("quota")).select(df.columns)


def feature_summary(df: DataFrame, categories: dict) -> DataFrame:
    """Number of features and of values by category, for the columns of ``df`` that ``categories`` names."""
    known = [c for c in df.columns if c in categories]
    counts = df.agg(F.array(*[F.struct(F.lit(categories[c]).alias("category"), F.count(c).alias("values")) for c in known]).alias("x"))
    return counts.select(F.explode("x").alias("x")).groupBy("x.category").agg(F.count(F.lit(1)).alias("features"), F.sum("x.values").alias("values"))


def attribution_ranking(importances: DataFrame, top: int = 10) -> DataFrame:
    """The importance table (one row a feature) with the share of the first ``top`` features."""
    table = importance_table(importances)
    share = table.where(F.col("rank") <= top).agg(F.coalesce(F.sum("pct"), F.lit(0.0)).alias("top_pct"))
    return table.crossJoin(F.broadcast(share))
