"""Running totals, positions and exact quantiles over one global order.

Rows are range-partitioned by the ordering keys into equal segments (a single
hot key splits as well, because the keys are unique together), each segment is
scanned on its own, and only one row per segment is combined in order.  The
scanned segments are written once: range bounds are sampled anew by every run of
an exchange, so both users of the segments must read the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from dailybars.plans.cut import written


def segments(df: DataFrame, keys, group=()) -> DataFrame:
    """Add ``seg``: a number that grows along the order of ``group`` + ``keys``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *group, *keys).withColumn("seg", F.spark_partition_id())


def with_totals(df: DataFrame, keys, group=(), sums=(), highs=()) -> DataFrame:
    """Positions and running values along the order.

    Adds ``pos`` (1-based) and ``n_rows`` per group; for (name, column) in ``sums``
    the running sum; for (name, sum_name) in ``highs`` the running maximum of that
    running sum.
    """
    seg = segments(df, keys, group)
    inside = W.partitionBy(*group, "seg").orderBy(*keys)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    seg = seg.withColumn("pos", F.row_number().over(inside))
    for name, column in sums:
        seg = seg.withColumn(name, F.sum(column).over(upto))
    for name, total in highs:
        seg = seg.withColumn(name, F.max(total).over(upto))
    seg = written(seg, "segments")
    parts = seg.groupBy(*group, "seg").agg(
        F.count(F.lit(1)).alias("p_n"),
        *[F.max_by(name, "pos").alias(f"p_{name}") for name, _ in sums],
        *[F.max(name).alias(f"p_{name}") for name, _ in highs])
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    earlier = over.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("b_n", F.coalesce(F.sum("p_n").over(earlier), F.lit(0)))
    offsets = offsets.withColumn("n_rows", F.sum("p_n").over(over))
    for name, _ in sums:
        offsets = offsets.withColumn(f"b_{name}", F.coalesce(F.sum(f"p_{name}").over(earlier), F.lit(0.0)))
    for name, total in highs:
        offsets = offsets.withColumn(f"b_{name}", F.max(F.col(f"b_{total}") + F.col(f"p_{name}")).over(earlier))
    offsets = offsets.select(*group, "seg", "n_rows", "b_n", *[f"b_{n}" for n, _ in [*sums, *highs]])
    out = seg.join(F.broadcast(offsets) if not group else offsets, [*group, "seg"])
    out = out.withColumn("pos", F.col("pos") + F.col("b_n"))
    for name, total in highs:
        out = out.withColumn(name, F.greatest(F.col(name) + F.col(f"b_{total}"), F.col(f"b_{name}")))
    for name, _ in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"b_{name}"))
    return out.drop("b_n", "seg", *[f"b_{n}" for n, _ in [*sums, *highs]])


def masked_paths(df: DataFrame, keys, value, masks: dict) -> DataFrame:
    """Running sums of ``value`` along one order, over the rows of each mask alone: mask, total, peak and deepest fall.

    All masks share one ordered scan.  A segment is summed up, mask by mask, by its sum, its highest and lowest running
    sum and its deepest fall; two neighbouring segments make one such summary again, so only these are put in order.
    A fall is measured from the highest sum reached so far, the first row's included.  Masks without rows have nulls.
    """
    names = list(masks)
    flagged = df.withColumns({f"m{i}": F.coalesce(masks[n], F.lit(False)) for i, n in enumerate(names)})
    seg = segments(flagged, keys)
    inside = W.partitionBy("seg").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    each = range(len(names))
    seg = seg.withColumns({f"s{i}": F.sum(F.when(F.col(f"m{i}"), value).otherwise(0.0)).over(inside) for i in each})
    seg = seg.withColumns({f"h{i}": F.max(F.when(F.col(f"m{i}"), F.col(f"s{i}"))).over(inside) for i in each})
    own = lambda i, c: F.when(F.col(f"m{i}"), c)
    brief = seg.groupBy("seg").agg(F.array(*[F.struct(
        F.lit(n).alias("mask"), F.sum(own(i, value)).alias("sum"), F.max(own(i, F.col(f"s{i}"))).alias("high"), F.min(own(i, F.col(f"s{i}"))).alias("low"),
        F.max(own(i, F.col(f"h{i}") - F.col(f"s{i}"))).alias("fall")) for i, n in enumerate(names)]).alias("x")).select("seg", F.explode("x").alias("x")).select("seg", "x.*")
    earlier = W.partitionBy("mask").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)  # one row a segment
    start = F.coalesce(F.sum("sum").over(earlier), F.lit(0.0))
    placed = brief.withColumn("start", start).withColumn("reached", F.max(F.col("start") + F.col("high")).over(earlier))
    return placed.groupBy("mask").agg(
        F.sum("sum").alias("total"), F.max(F.col("start") + F.col("high")).alias("peak"),
        F.max(F.greatest("fall", F.col("reached") - (F.col("start") + F.col("low")))).alias("deepest_fall"))


def exact_quantiles(df: DataFrame, column: str, shares: dict, group=(), unique=()) -> DataFrame:
    """Linear-interpolation quantiles: one row per group, one column per name in ``shares``.

    ``unique`` names columns that make rows distinct, so that equal values spread over segments.
    """
    placed = with_totals(df.where(F.col(column).isNotNull()).select(*group, column, *unique), [column, *unique], group)
    made = []
    for name, q in shares.items():
        at = (F.col("n_rows") - 1) * F.lit(float(q)) + 1
        low = F.max(F.when(F.col("pos") == F.floor(at), F.col(column)))
        high = F.max(F.when(F.col("pos") == F.ceil(at), F.col(column)))
        part = F.max(at - F.floor(at))
        made.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*group).agg(*made) if group else placed.agg(*made)
