"""How much goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bytes of a batch that goes to a Python worker; one larger row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches() -> None:
    """From now on the session's batches for Python workers are bounded in bytes, so that none grows with the texts or the rows of a task."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
