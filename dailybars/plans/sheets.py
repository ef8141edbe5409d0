"""Run a sheet of features on a numbered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dailybars.plans.blocks import BLOCK_ROWS, into_blocks
from dailybars.plans.order_stats import window_counts


def run_sheet(df: DataFrame, sheet, outputs, keep=("date",), size: int = BLOCK_ROWS) -> DataFrame:
    """Evaluate ``outputs`` (name -> Term) on rows that carry ticker, rn, n_rows.

    All windows share one partitioning and order, so the plan has a single
    exchange and sort; every further stage only adds window passes.
    """
    stages, needed = sheet.stages(outputs)
    carried = [c for c in dict.fromkeys(("ticker", "rn", *keep)) if c in df.columns]
    need = list(dict.fromkeys([*carried, *(c for c in needed if c != "blk")]))
    back = max((t.back for t in outputs.values()), default=0)
    frame = into_blocks(df.select(*need, "n_rows") if "n_rows" not in need else df.select(*need), back, size=size)
    frame = frame.select(*need, "blk", "own")
    stay = list(dict.fromkeys([*carried, "blk", "own"]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # windows cost more than their bytes tell
    frame = frame.repartition(parts, "ticker", "blk").sortWithinPartitions("ticker", "blk", "rn")
    for passed, made, counts in stages:
        through = list(dict.fromkeys([*stay, *passed]))
        if counts:
            frame = frame.withColumn("counts", window_counts([key for _, key in counts]))
            frame = frame.withColumns({f"{n}{k}": F.col(f"counts.{k}{i}") for i, (n, _) in enumerate(counts) for k in "ba"}).drop("counts")
        frame = frame.selectExpr(*through, *(f"{sql} as {name}" for name, sql in made))
    return frame.where("own").selectExpr(*carried, *(f"{t.sql} as {n}" for n, t in outputs.items()))
