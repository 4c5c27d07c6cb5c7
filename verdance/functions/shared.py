"""Tables between passes, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on a local master alone, a folder of our own that ends with the process."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="verdance-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def settled(df: DataFrame) -> DataFrame:
    """df worked out once: written to the shared folder and read again, so that plans that use it several times stay short
    and a lost executor costs no recomputation before this point."""
    path = f"{shared_dir(df.sparkSession)}/verdance-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
