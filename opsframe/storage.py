"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _own(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="opsframe-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and everything is one process."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = conf.get("spark.master", "local")
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own(spark.sparkContext.applicationId)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: the lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/opsframe-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
