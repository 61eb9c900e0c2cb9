"""Tables and the base views of telemetry that the operators start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Named sources: a router picks one of them (for example a log backend) and keeps it.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def source(name: str):
    def put(f):
        SOURCES[name] = f
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; predicates on plain columns and column lists reach its scan.

    Its schema is read from a file once a session and state of the table, not by a job for each query.
    """
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    key = (spark.sparkContext.applicationId, path)
    known = _schemas.get(key)
    if known is None or known[0] != changed:
        known = _schemas[key] = (changed, spark.read.parquet(path).schema)
    return spark.read.schema(known[1]).parquet(path)


_schemas: dict[tuple[str, str], tuple[int, StructType]] = {}


def select_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; there are {sorted(SOURCES)}")
    return SOURCES[name](spark, sf_dir)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone (UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


@source("samples")
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: hot labels are columns, so that their predicates are pushed down; t is in microseconds."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("host"), "value", micros("ts").alias("t"))


@source("logs")
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records: id, t, service, host, severity_text, message."""
    e = read(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 100, "warn").otherwise("info")
    return e.select(
        F.col("event_id").alias("id"), micros("ts").alias("t"), F.col("event_type").alias("service"), F.col("user_id").alias("host"),
        level.alias("severity_text"), F.concat_ws(" ", "event_type", "props").alias("message"),
    )


#: The same two views for the SQL oracles.
SAMPLES_SQL = "samples AS (SELECT event_type AS name, user_id AS host, value, epoch_us(ts) AS t FROM events)"
LOGS_SQL = (
    "logs AS (SELECT event_id AS id, epoch_us(ts) AS t, event_type AS service, user_id AS host, "
    "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 THEN 'warn' ELSE 'info' END AS severity_text, event_type || ' ' || props AS message FROM events)"
)
