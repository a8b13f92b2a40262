"""Python workers that give their memory back, and what travels to them at a time.

An executor keeps idle workers for a minute. What a worker has freed but still holds
from the system then lies beside the next stage's memory.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: The session's bound of an Arrow batch, and the bytes taken where it isn't set.
BOUND, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes. Spark's own bound is 10,000 rows: batches of whole
    texts then take tens of MB, twice that while they grow, in each task and its worker."""
    if spark.conf.get(BOUND, None) is None:
        spark.conf.set(BOUND, str(BATCH))


def tidy(run):
    """run, a function over Arrow batches, that returns freed memory to the system at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied
