"""Results that are needed again, kept where all executors see them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder all executors share; on one machine without one, in a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="sigmill-"))
    return df.checkpoint()
