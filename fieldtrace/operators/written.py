"""Tables written between the steps of an operator."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and reread, so that plans and their constraints start anew and lost executors cost nothing.

    A local folder serves only where the session names none and runs on one machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="fieldtrace-"))
    folder = f"{sc.getCheckpointDir().rstrip('/')}/cut-{uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder)
