"""A frame that several branches of a plan read, written once.

The table goes to the shared folder that ``spark.checkpoint.dir`` names, so a
lost executor re-reads files, the columns a branch does not use are not read,
and the optimizer knows its size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from churnlens.session import ensure_checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
