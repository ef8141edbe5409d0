"""Splits, evaluation, threshold search and candidate lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dailybars.operators.filters import apply_entry_filters
from dailybars.operators.stops import StopConfig, stop_columns
from dailybars.plans.asof import asof_by_ticker
from dailybars.plans.ordered import with_totals

# Columns that are never model inputs.
NOT_FEATURES = {"ticker", "date", "rn", "n_rows", "5d_return", "10d_return", "open", "high", "low", "close", "adj close", "adj_close"}


def split_by_date(df: DataFrame, train_end, val_end, test_end, train_start=None) -> DataFrame:
    """Column ``split``: train, validation or test by inclusive end dates; other rows are dropped."""
    d, day = F.col("date"), lambda x: F.lit(x).cast("date")
    started = F.lit(True) if train_start is None else d >= day(train_start)
    split = (F.when(started & (d <= day(train_end)), "train").when((d > day(train_end)) & (d <= day(val_end)), "validation")
             .when((d > day(val_end)) & (d <= day(test_end)), "test"))
    return df.withColumn("split", split).where("split is not null")


def feature_columns(df: DataFrame, enabled=None) -> list[str]:
    """Model inputs in table order: no labels, keys, forward returns or raw prices; only enabled ones."""
    names = [c for c in df.columns if c not in NOT_FEATURES and not c.startswith("label_")]
    return [n for n in names if enabled is None or n in set(enabled)]


def prepare_matrix(df: DataFrame, names) -> DataFrame:
    """Infinite and null values become 0, the rest is clipped to one million either way."""
    def tidy(n):
        x = F.col(n)
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), x.cast("double")))).alias(n)
    return df.select(*[c for c in df.columns if c not in set(names)], *[tidy(n) for n in names])


def fill_missing_features(df: DataFrame, names, least_overlap: float = 0.5) -> DataFrame:
    """Absent model columns become 0.0; too few present ones is an error."""
    have = set(df.columns)
    present = [n for n in names if n in have]
    if len(present) < len(names) * least_overlap:
        raise ValueError(f"only {len(present)} of {len(names)} model features present")
    return df.withColumns({n: F.lit(0.0) for n in names if n not in have})


def fill_for_scoring(df: DataFrame, names) -> DataFrame:
    return fill_missing_features(df, names, 0.8)


def class_weight(df: DataFrame, label: str, multiplier: float = 1.0) -> DataFrame:
    """Negatives per positive of the training rows, times a multiplier."""
    t = df.where("split = 'train'") if "split" in df.columns else df
    pos = F.count(F.when(F.col(label) == 1, 1))
    neg = F.count(F.when(F.col(label) == 0, 1))
    return t.agg(pos.alias("positives"), neg.alias("negatives"), (F.try_divide(neg * 1.0, pos) * multiplier).alias("weight"))


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """Always the most frequent training class: its accuracy per split, AUC one half."""
    top = df.where("split = 'train'").groupBy(label).count().agg(F.max_by(label, F.struct("count", -F.col(label))).alias("predicted"))
    scored = df.crossJoin(F.broadcast(top))
    return scored.groupBy("split").agg(F.first("predicted").alias("predicted"), F.count(F.lit(1)).alias("rows"),
                                       F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("accuracy"),
                                       F.lit(0.5).alias("auc"))


def score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative positives and rows from the highest score down, one row per distinct score."""
    by_score = scored.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("double")).alias("hits"), F.count(F.lit(1)).cast("double").alias("rows"))
    by_score = by_score.withColumn("down", -F.col("threshold"))
    return with_totals(by_score, ["down"], sums=[("tp", "hits"), ("flagged", "rows")])


def precision_recall(scored: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, tp, flagged, precision, recall, f1 for flagging every row at or above a score."""
    counts = score_counts(scored, label, score)
    total = counts.agg(F.max("tp").alias("positives"), F.max("flagged").alias("total"))
    p, r = F.col("tp") / F.col("flagged"), F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(0.0))
    curve = counts.crossJoin(F.broadcast(total)).withColumn("precision", p).withColumn("recall", r)
    f1 = 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + 1e-10)
    return curve.withColumn("f1", f1).select("threshold", "tp", "flagged", "positives", "total", "hits", "rows", "precision", "recall", "f1")


def find_threshold(scored: DataFrame, label: str, score: str, target_precision=None, target_recall=None, best="f1") -> DataFrame:
    """The threshold nearest a target precision or recall, of the best F1, or of the best precision at recall >= 0.3.

    The curve also has the closing point of precision 1 and recall 0, which
    stands for the highest threshold; ties go to the lowest threshold.
    """
    curve = precision_recall(scored, label, score).withColumn("closing", F.lit(0))
    top = curve.agg(F.max_by(F.struct(*[c for c in curve.columns]), "threshold").alias("x")).select("x.*")
    closing = top.withColumns({"precision": F.lit(1.0), "recall": F.lit(0.0), "f1": F.lit(0.0), "closing": F.lit(1)})
    points = curve.unionByName(closing)
    first = F.struct(F.col("threshold"), F.col("closing"))
    if target_precision is not None:
        rank = F.struct(F.abs(F.col("precision") - target_precision), first)
    elif target_recall is not None:
        rank = F.struct(F.abs(F.col("recall") - target_recall), first)
    elif best == "precision":
        usable = F.when(F.col("recall") >= 0.3, 0).otherwise(1)
        rank = F.struct(usable, F.when(usable == 0, -F.col("precision")).otherwise(-F.col("f1")), first)
    else:
        rank = F.struct(-F.col("f1"), first)
    pick = points.agg(F.min_by(F.struct(*points.columns), rank).alias("x")).select("x.*")
    fp = F.col("flagged") - F.col("tp")
    n = lambda c: c.cast("bigint")
    return pick.select(
        F.col("threshold").alias("optimal_threshold"), "precision", "recall", F.col("f1").alias("f1_score"),
        n(F.col("total") - F.col("positives") - fp).alias("true_negatives"), n(fp).alias("false_positives"),
        n(F.col("positives") - F.col("tp")).alias("false_negatives"), n(F.col("tp")).alias("true_positives"),
        n(F.col("total")).alias("total_predictions"), n(F.col("flagged")).alias("positive_predictions"),
        (F.col("flagged") / F.col("total")).alias("positive_rate"))


def outcome_counts(pred: Column, label: str):
    y = F.col(label) == 1
    n = lambda c: F.count(F.when(c, 1))
    return [n(pred & y).alias("tp"), n(pred & ~y).alias("fp"), n(~pred & y).alias("fn"), n(~pred & ~y).alias("tn")]


def ratio(a, b):
    return F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))


def threshold_sweep(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Precision, recall, F1 and positive rate at 0.10, 0.15, ... 0.90."""
    steps = [round(0.10 + 0.05 * i, 2) for i in range(17)]
    met = sum((F.coalesce(F.col(score) >= s, F.lit(False)).cast("int") for s in steps), F.lit(0))  # how many thresholds a score reaches
    bins = scored.where(F.col(score).isNotNull()).groupBy(met.alias("met")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("ones"), F.count(F.when(F.col(label) != 1, 1)).alias("zeros"))
    at = bins.select("met", "ones", "zeros", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("nr"), F.lit(s).alias("threshold")) for i, s in enumerate(steps)])).alias("s"))  # 18 rows of bins
    total = lambda c, hit: F.sum(F.when((F.col("met") >= F.col("s.nr")) == hit, F.col(c)).otherwise(0))
    t = at.groupBy("s.threshold").agg(total("ones", F.lit(True)).alias("tp"), total("zeros", F.lit(True)).alias("fp"), total("ones", F.lit(False)).alias("fn"), total("zeros", F.lit(False)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select("threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"), (tp + fp).alias("positive_predictions"),
                    ratio(tp + fp, tp + fp + fn + tn).alias("positive_rate"))


def evaluate(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """AUC, average precision and the confusion-based measures of a score."""
    curve = precision_recall(scored, label, score)
    fp, neg = F.col("flagged") - F.col("tp"), F.col("total") - F.col("positives")
    before_tp, step_neg = F.col("tp") - F.col("hits"), F.col("rows") - F.col("hits")
    ranked = curve.agg(
        F.sum(F.try_divide(step_neg * (F.col("tp") + before_tp) / 2, F.col("positives") * neg)).alias("roc_auc"),
        F.sum(F.col("precision") * F.try_divide(F.col("hits"), F.col("positives"))).alias("average_precision"))
    c = scored.agg(*outcome_counts(F.col(score) >= threshold, label))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.crossJoin(ranked).select(
        "roc_auc", "average_precision", ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        "tp", "fp", "fn", "tn")


def search_models(models: DataFrame, name=None, min_accuracy=None, min_auc=None, feature_set=None, horizon=None) -> DataFrame:
    """Rows of a model-metrics table that meet every given condition."""
    tests = [
        F.lower("name").contains(name.lower()) if name else None,
        F.col("accuracy") >= min_accuracy if min_accuracy is not None else None,
        F.col("auc") >= min_auc if min_auc is not None else None,
        F.col("feature_set") == feature_set if feature_set else None,
        F.col("horizon") == horizon if horizon is not None else None]
    return models.where(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True)))


def latest_rows(features: DataFrame) -> DataFrame:
    """Last row of each ticker (the maximum is combined map-side)."""
    rest = F.struct(*[c for c in features.columns if c != "ticker"])
    return features.groupBy("ticker").agg(F.max_by(rest, "date").alias("r")).select("ticker", "r.*")


def opportunities(scored: DataFrame, probability: str = "probability", least: float = 0.5, top: int = 20,
                  filters=(), stops: StopConfig | None = None) -> DataFrame:
    """Latest row per ticker that passes the filters with enough probability, best first.

    The price is the latest close; adaptive stops are measured from it.
    """
    now = apply_entry_filters(latest_rows(scored), filters).where(F.col(probability) >= least)
    adaptive = stops is not None and stops.mode in ("adaptive_atr", "swing_atr")
    stop = stop_columns(stops, now.columns, "close")["stop_loss_pct"] if adaptive else F.lit(None).cast("double")
    return (now.select("ticker", F.col(probability).alias("probability"), F.col("close").alias("current_price"),
                       stop.alias("stop_loss_pct"), "date")
            .orderBy(F.col("probability").desc(), "ticker").limit(top))


def entry_features(trades: DataFrame, features: DataFrame, names) -> DataFrame:
    """Each trade with the features of its entry date, or of the last date before it; others are dropped."""
    right = features.select("ticker", F.col("date").alias("feature_date"), *names)
    left = trades.select("ticker", "entry_date", "exit_reason", "return", "pnl", "holding_days")
    return asof_by_ticker(left, right, "entry_date", "feature_date")


def entry_skips(trades: DataFrame, features: DataFrame) -> DataFrame:
    """How many trades have features at their entry, and why the others have none."""
    named = F.col("ticker").isNotNull() & (F.col("ticker") != "UNKNOWN")
    usable = trades.where(named & F.col("entry_date").isNotNull())
    first = features.groupBy("ticker").agg(F.min("date").alias("first"))
    n = lambda c: F.count(F.when(c, 1))
    late = usable.join(first, "ticker", "left").agg(n(F.col("first") <= F.col("entry_date")).alias("with_features"), n(F.col("first").isNull() | (F.col("first") > F.col("entry_date"))).alias("no_features"))
    return late.crossJoin(trades.agg(n(~F.coalesce(named, F.lit(False))).alias("no_ticker"), n(F.coalesce(named, F.lit(False)) & F.col("entry_date").isNull()).alias("no_date")))  # one row each


def exact_entry_features(trades: DataFrame, features: DataFrame, names) -> DataFrame:
    right = features.select("ticker", F.col("date").alias("entry_date"), *names)
    return trades.join(right, ["ticker", "entry_date"], "left")
