"""Table access and Arrow batch size shared by the operators of this package."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, handed to Python at once. Texts may be long, so batches are kept small.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: The white space of every word split in this package.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# mallopt's names of the size from which memory is mapped alone, and of the free top that is kept.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1


def _return_freed_memory(size: int = 1 << 20) -> None:
    """Blocks of ``size`` bytes and more go back to the system when freed.

    Spark keeps its Python workers from stage to stage. By default the allocator raises its
    limits after the first large block, and Arrow's pool keeps pages, so an idle worker would
    hold what its largest task took.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(_MMAP_THRESHOLD, size)
        mallopt(_TRIM_THRESHOLD, size)


# Run where this package is imported: in the workers, by the functions they unpickle.
_return_freed_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the document number written in decimal, modulo ``modulus``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus
