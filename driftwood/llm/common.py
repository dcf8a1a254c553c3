"""What the training-data operators share: tables, the shared folder, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.sources.shared import checkpointed as written
from driftwood.sources.shared import purge, shared_dir

__all__ = ["SPACE", "WORD", "free_name", "held_out", "in_arrow", "purge", "release", "shared_dir", "slices", "table", "written"]

#: White space of the word and line rules: blank and \t \n \v \f \r. A fixed set.
SPACE = " \t\n\x0b\f\r"
#: The word rule as a Java/RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def release() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can. A
    worker serves many tasks, and would else keep what the largest of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` holds about ``most_bytes`` at
    most (one row at least), so that Python objects of few rows live at a time."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``rows.mapInArrow`` with batches of 4 MB, or one row. Spark's 64 MB of whole texts would
    stand in the executor's and the worker's memory, for each task. A session that sets the
    size itself keeps its own; elsewhere the setting stays for the session."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, "4m")
    return rows.mapInArrow(run, schema)


def held_out(id_col: str, modulus: int, remainder: int = 2):
    """crc32(id as text) mod ``modulus`` is ``remainder``; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
