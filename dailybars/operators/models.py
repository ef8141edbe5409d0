"""Classifiers with MLlib: baselines, boosted trees, search, permutation importance."""

from __future__ import annotations

import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.operators.scoring import class_weight
from dailybars.plans.cut import written
from dailybars.plans.ordered import with_totals

# The defaults of the boosted model.
TREES, DEPTH, RATE = 300, 5, 0.05


def weighted(df: DataFrame, label: str, multiplier: float = 1.0) -> DataFrame:
    """Positives weigh as many times more as there are more negatives in the training rows."""
    w = class_weight(df, label, multiplier).select("weight")
    return df.crossJoin(F.broadcast(w)).withColumn("weight", F.when(F.col(label) == 1, F.col("weight")).otherwise(1.0))


def assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def with_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def logistic_baseline(train: DataFrame, features, label: str):
    """Logistic regression with balanced classes on scaled inputs."""
    return Pipeline(stages=[
        assembler(features), StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=100)]).fit(train)


def boosted(train: DataFrame, features, label: str, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, seed: int = 42, **params):
    """Boosted trees that stop early on the validation rows (column ``is_validation``)."""
    if "is_validation" in train.columns:
        params["validationIndicatorCol"] = "is_validation"
    gbt = GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, **params)
    return Pipeline(stages=[assembler(features), gbt]).fit(train)


def auc(model, df: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(df))


# The parameter lists searched.
SPACE = {"trees": [100, 200, 300], "depth": [3, 4, 5, 6], "rate": [0.01, 0.05, 0.1], "subsamplingRate": [0.7, 0.8, 1.0],
         "minInstancesPerNode": [1, 3, 5], "minInfoGain": [0.0, 0.1], "maxBins": [32, 64],
         "featureSubsetStrategy": ["all", "sqrt", "onethird"], "minWeightFractionPerNode": [0.0, 0.01]}


def binned(df: DataFrame, features, bins: int = 64) -> DataFrame:
    """Features as bin numbers between quantiles of ``df`` (one pass), assembled; rows without a value get a bin of their own."""
    shares = [k / bins for k in range(1, bins)]
    edges = [[-float("inf"), *sorted(set(q)), float("inf")] for q in df.approxQuantile(list(features), shares, 0.001)]
    made = [f"bin_{f}" for f in features]
    cut = Bucketizer(inputCols=list(features), outputCols=made, splitsArray=edges, handleInvalid="keep").transform(df)
    cut = cut.withColumns({m: F.col(m) + 0.0 for m in made})  # numbers in order, not categories
    return VectorAssembler(inputCols=made, outputCol="features").transform(cut).drop(*made)


def with_folds(df: DataFrame, folds: int, by_time: bool = False, seed: int = 42) -> DataFrame:
    """Add ``fold``: 0 to ``folds`` - 1 by a seeded hash, or 0 to ``folds`` by equal runs of calendar days."""
    if not by_time:
        return df.withColumn("fold", F.pmod(F.xxhash64("ticker", "date", F.lit(seed)), F.lit(folds)).cast("int"))
    days = df.select("date").distinct()  # one row per calendar day
    part = days.withColumn("fold", F.ntile(folds + 1).over(W.orderBy("date")) - 1)
    return df.join(part, "date")


def fold_parts(df: DataFrame, k: int, by_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of fold ``k``; over time, the days up to it and the run behind them."""
    fold = F.col("fold")
    return (df.where(fold <= k), df.where(fold == k + 1)) if by_time else (df.where(fold != k), df.where(fold == k))


def draws(n_iter: int = 20, space=None, seed: int = 42) -> list[dict]:
    """Seeded draws of one value from each parameter list."""
    space, draw = space or SPACE, random.Random(seed)
    return [{k: draw.choice(v) for k, v in sorted(space.items())} for _ in range(n_iter)]


def stored_folds(train: DataFrame, features, label: str, folds: int = 3, by_time: bool = False, seed: int = 42) -> DataFrame:
    """The table that every fit of a search reads: bins, label, weight and fold, written once.

    ``is_validation`` marks a tenth of the rows by which a fit may stop early; the fold it is scored by is not among them.
    """
    marked = with_folds(train, folds, by_time, seed).withColumn("is_validation", F.pmod(F.xxhash64("ticker", "date", F.lit(seed + 1)), F.lit(10)) == 0)
    return written(binned(marked, features).select("features", label, "weight", "fold", "is_validation"), "folds")


def random_search(train: DataFrame, features, label: str, n_iter: int = 20, folds: int = 3, by_time: bool = False, space=None, seed: int = 42, together: int = 8):
    """Mean AUC of ``n_iter`` seeded draws, best first: (parameters, AUC).

    All fits read one stored table, ``together`` of them at a time, and stop when their own validation rows gain less than a thousandth.
    """
    table, found = stored_folds(train, features, label, folds, by_time, seed), draws(n_iter, space, seed)

    def fit(job):
        params, k = dict(job[0]), job[1]
        a, b = fold_parts(table, k, by_time)
        gbt = GBTClassifier(labelCol=label, weightCol="weight", seed=seed, validationIndicatorCol="is_validation", validationTol=0.001,
                            maxIter=params.pop("trees"), maxDepth=params.pop("depth"), stepSize=params.pop("rate"), **params)
        return auc(gbt.fit(a), b, label)

    with ThreadPool(together) as pool:
        scores = pool.map(inheritable_thread_target(train.sparkSession)(fit), [(p, k) for p in found for k in range(folds)])
    means = [sum(scores[i * folds:(i + 1) * folds]) / folds for i in range(len(found))]
    return sorted(zip(found, means), key=lambda r: -r[1])


def paired(df: DataFrame, features, label: str, seed: int = 42) -> DataFrame:
    """Each row with the features of another one (``other_``): row k of one random order meets row k of a second, stored once."""
    keys = ["ticker", "date"]
    order = lambda k: F.md5(F.concat_ws("|", "ticker", F.col("date").cast("string"), F.lit(str(k)))).alias("order")
    place = lambda d, k: with_totals(d.withColumn("order", order(k)), ["order", *keys])
    rows = place(df.select(*keys, label, *features), seed).select("pos", label, *features)
    others = place(df.select(*keys, *features), seed + 1).select("pos", *[F.col(f).alias(f"other_{f}") for f in features])
    return written(rows.join(others, "pos").drop("pos"), "paired")


def grouped_auc(scored: DataFrame, group: str, label: str, score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs in the right order for each group; equal scores count half."""
    y = F.col(label)
    counts = scored.groupBy(group, score).agg(F.sum((y == 1).cast("double")).alias("ones"), F.sum((y == 0).cast("double")).alias("zeros"))
    placed = with_totals(counts, [score], (group,), sums=[("zeros_upto", "zeros")])
    return placed.groupBy(group).agg(
        F.try_divide(F.sum(F.col("ones") * (F.col("zeros_upto") - F.col("zeros") / 2)), F.sum("ones") * F.sum("zeros")).alias("auc"))


def permutation_importance(score, df: DataFrame, features, label: str, seed: int = 42) -> DataFrame:
    """feature, importance: AUC lost when a feature's values come from other rows, not below 0.

    ``score`` adds a column ``score`` to rows with ``features``.  All features are scored in one pass over the stored pairs.
    """
    features = list(features)
    variant = lambda f: F.struct(F.lit(f or "").alias("variant"), F.col(label).alias(label), *[F.col(f"other_{c}" if c == f else c).alias(c) for c in features])
    rows = paired(df, features, label, seed).select(F.explode(F.array(*[variant(f) for f in (None, *features)])).alias("x")).select("x.*")
    by = grouped_auc(score(rows), "variant", label)
    whole = by.where("variant = ''").select(F.col("auc").alias("whole"))
    return by.where("variant <> ''").crossJoin(F.broadcast(whole)).select(F.col("variant").alias("feature"), F.greatest(F.col("whole") - F.col("auc"), F.lit(0.0)).alias("importance"))


def line(train: DataFrame, feature: str, label: str) -> DataFrame:
    """The least-squares line of a label on one feature: one row with slope and intercept."""
    y = F.col(label).cast("double")
    return train.agg(F.regr_slope(y, F.col(feature)).alias("slope"), F.regr_intercept(y, F.col(feature)).alias("intercept"))


def line_probability(df: DataFrame, fitted: DataFrame, feature: str, digits: int = 4) -> DataFrame:
    """``probability`` by a fitted line, kept between 0 and 1."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("intercept") + F.col("slope") * F.col(feature)))
    return df.crossJoin(F.broadcast(fitted)).withColumn("probability", F.round(F.when(F.col(feature).isNotNull(), p) + 1.3e-8, digits)).drop("slope", "intercept")


def logistic_gradient(model, df: DataFrame, features, label: str) -> DataFrame:
    """feature, gradient: slope of the mean weighted loss along each scaled input, and along the intercept; near 0 where a fit has ended."""
    scored = model.transform(df).select(vector_to_array("scaled").alias("x"), vector_to_array("probability")[1].alias("p"), F.col(label).alias("y"), "weight")
    pull = F.col("weight") * (F.col("p") - F.col("y"))
    names = [*features, "intercept"]
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.sum(pull * (F.col("x")[i] if i < len(features) else F.lit(1.0))).alias("s")) for i, n in enumerate(names)])
    total = scored.agg(entries.alias("e"), F.sum("weight").alias("w"))
    return total.select(F.explode("e").alias("e"), "w").select("e.feature", (F.col("e.s") / F.col("w")).alias("gradient"))


def losses_by_tree(model, df: DataFrame, label: str) -> list[float]:
    """Loss of the first k trees of a boosted model for every k."""
    ready = model.stages[0].transform(df).withColumn(label, F.col(label).cast("double"))
    return list(model.stages[-1].evaluateEachIteration(ready))
