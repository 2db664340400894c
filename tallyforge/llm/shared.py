"""What the operators share: places that every machine sees, written tables, columns that can't clash.

Shared folder. Files that one task writes and another reads go below the folder in
``spark.checkpoint.dir``. It is read from the session; only where it is unset (local tests) a local
folder is made and set.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sizes import joined_by_size, sized, small, spread  # noqa: F401  (operators take them from here)

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI. Without the setting, a local folder, for single-machine runs only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(_local[app])
    return _local[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tallyforge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet in the shared folder and reads them back.

    A lost executor loses nothing that was written. The folder stays until ``clean`` is called or the
    checkpoint folder is emptied, as with ``checkpoint()``."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what operators of this application have written in the shared folder. Results that read it are no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallyforge/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, as a text may have any length; the same for all operators. Whole texts still pass."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def settle() -> None:
    """Gives memory that is free back to the machine, as Python workers live on after a task, and the driver after a fit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def draw(*columns: str) -> Column:
    """A number from 0 to 2^62 that a hash of the columns gives, for samples of any smallness."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def share(part: float) -> int:
    """Below this lie the draws of that part of all."""
    return int(min(part, 1.0) * (1 << 62))


def chosen_map(parts: dict) -> Column:
    """A map column of a few keys, one at least."""
    return F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])


def cased(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, by exact name, so that further or clashing columns (``Text``, ``text ``)
    of the input never reach the operator. Of equal names, the first counts."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{df.columns.index(c)}").alias(c) for c in wanted])


def filtered(df: DataFrame, run) -> DataFrame:
    """Rows of ``mapInArrow(run)``, which keeps the schema. Columns go by place meanwhile, so that names can clash."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
