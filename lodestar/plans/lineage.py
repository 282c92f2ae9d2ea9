"""Cutting the lineage of iterative plans through the session's shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: So many short rows may be sent to all.
FEW_ROWS = 200_000


#: The sessions' folders, which are deleted when the driver's process ends.
_OWN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestar-"))
    own = context.getCheckpointDir()  # a folder of this session alone, within the one that was named
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_drop, spark, own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, of which later plans read only the columns they need."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema: a plan without a task, where an empty list would be read by Python workers."""
    return spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def few(rows: DataFrame) -> DataFrame:
    """``rows`` to be sent to all if they are few, else to be joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows
