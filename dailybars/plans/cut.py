"""Tables written between two long plans, so lost executors only repeat the second."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is unset and there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="dailybars-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """Store ``df`` as a warehouse table dealt out by ``key``, so grouping and joining by it need no further shuffle of it.

    With ``dealt`` the rows already lie by ``key`` and are written as they come.
    """
    spark = df.sparkSession
    parts, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(parts, key)).write.bucketBy(parts, key).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)
