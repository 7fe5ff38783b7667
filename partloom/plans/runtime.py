"""What queries need from a session: the lineage cut of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a session on one machine, such as tests
    run in, gets a local one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="partloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cutter(spark: SparkSession):
    """`cut(df)`: the frame written once to the shared folder and read again."""
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    count = 0

    def cut(df: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        path = f"{root}/{count}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut
