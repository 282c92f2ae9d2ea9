"""What several operators share: durable cuts of lineage, table reads, byte-level tokenising."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many short rows may be sent to all.
FEW_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The sessions' folders, which are deleted when the driver's process ends.
_OWN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where ``spark.checkpoint.dir`` is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestar-"))
    own = context.getCheckpointDir()  # a folder of this session alone, within the one that was named
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(drop, spark, own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more; a session that has ended is no error."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        return


def few(rows: DataFrame) -> DataFrame:
    """``rows`` to be sent to all if they are no more than FEW_ROWS short ones, else to be joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there on.

    The shared store keeps it, so a lost executor costs a re-read and never a failure. What was
    shuffled to make it is not needed any more and is dropped.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    free_shuffles(df.sparkSession)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What is run inside gives Python workers at most so many rows at once: whole texts, so memory stays bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: 1 where a byte is one of the separators 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    filled = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [x or b"" for x in filled.to_pylist()]
