"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_UNSET: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local master may lack that setting (as in tests); it then gets a
    temporary folder.  A cluster without it is an error, since a folder of one
    machine is not visible to the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _UNSET.setdefault("dir", tempfile.mkdtemp(prefix="quillon-"))


#: Removes a query's shuffle files when it ends: a written table is read from its own files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch.  With a limit the engine adds up the batch's buffers for each row, most of the cost of narrow rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """The setting, for what runs inside."""
    before = spark.conf.get(key, None)
    if before is None:  # an engine without it
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors.

    With ``narrow``, for plans that send only rows of a few numbers to Python,
    Arrow batches are bounded by their rows alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _set(spark, CLEANUP, "true"), _set(spark, BATCH_BYTES, str(2**31 - 1)) if narrow else nullcontext():
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{scratch_dir(spark)}/quillon/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing reads any more, as what was made of them is itself written."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)


def remove_shuffles(spark: SparkSession) -> None:
    """Removes shuffle files that no plan needs any more: now and then :data:`CLEANUP` leaves some until garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that read them must be written before."""
    _delete(spark, f"{scratch_dir(spark)}/quillon/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
