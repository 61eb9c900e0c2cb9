"""What the training-data operators share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

if TYPE_CHECKING:
    import pyarrow as pa

    ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows and bytes of one Arrow batch: a worker holds one batch of whole texts at a time.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can take, for very long rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}/{name}"


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df in at most max(24, rows / 4096) partitions, for results whose size follows `rows`: no swarm of tiny files."""
    return df.coalesce(max(24, rows >> 12))


def materialize(df: DataFrame, name: str, rows: int | None = None, native: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives a lost executor. rows: see few_files().

    On a shared mount (file:), Spark's writer starts several processes a file to set permissions; there
    the tasks write Parquet through Arrow, unless `native`. Each attempt writes a file of its own name and
    only the names that successful tasks return are read, so a task that runs twice does no harm.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df = df if rows is None else few_files(df, rows)
    if native or not path.startswith("file:"):
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return _through_arrow(df, path, lambda batches: batches, df.schema)


def map_to_table(df: DataFrame, f: ArrowMap, schema: str, name: str, rows: int | None = None, owner: str = "") -> DataFrame:
    """materialize(df.mapInArrow(f, schema)), where the worker that runs f writes its file too. owner: whose cached() things f uses."""
    path = fresh_path(df.sparkSession, name)
    df = df if rows is None else few_files(df, rows)
    if not path.startswith("file:"):
        df.mapInArrow(f, schema).write.parquet(path)
        return df.sparkSession.read.schema(schema).parquet(path)
    return _through_arrow(df, path, f, schema, owner)


def _through_arrow(df: DataFrame, path: str, f: ArrowMap, schema, owner: str = "") -> DataFrame:
    spark = df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        release(owner)
        out, file = None, f"{path}/part-{uuid.uuid4().hex}.parquet"
        for b in f(batches):
            if b.num_rows:
                if out is None:
                    store, at = fs.FileSystem.from_uri(file)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = pq.ParquetWriter(at, b.schema, filesystem=store, compression="snappy")
                out.write_batch(b)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file]})

    files = [r["file"] for r in df.mapInArrow(write, "file string").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


#: Seconds that a worker keeps what it has cached after the last task that asked for it.
IDLE = 10.0
_cache: dict[str, dict[str, Any]] = {}
_asked = [0.0]


def cached(owner: str, key: str, make: Callable[[], Any]) -> Any:
    """make() once a worker and key. A worker lives on and runs other operators' tasks: it keeps what the
    last owner made for one key, nothing of others, and nothing at all IDLE seconds after it was last asked for."""
    _asked[0] = time.monotonic()
    found = _cache.get(owner, {}).get(key)
    if found is None:
        release()
        found = make()
        _cache[owner] = {key: found}
        _asked[0] = time.monotonic()
        threading.Thread(target=_drop_when_idle, daemon=True).start()
    return found


def _drop_when_idle() -> None:
    """A worker that gets no task waits for one; this runs meanwhile. A task that still uses a thing holds it itself."""
    while (left := _asked[0] + IDLE - time.monotonic()) > 0:
        time.sleep(left)
    release()


def release(owner: str = "") -> None:
    """Drop what a worker has cached for others than owner, and give freed memory back."""
    import ctypes
    import gc

    for other in [k for k in _cache if k != owner]:
        _cache.pop(other, None)
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fold(id_col: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def text_key() -> Column:
    """Hash of the column text: tells apart rows whose doc_id is null or repeats."""
    return F.xxhash64(F.col("text").cast("string"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is the same on pure ASCII and faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
