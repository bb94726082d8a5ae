"""What the training-data operators share: tables, work folders, code shipping, memo tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, broadcast_if_small, discard, materialize, new_path, ship_package, work_dir  # noqa: F401

#: Rows of a batch between the JVM and Python at most: texts are long, and batches are held on both sides.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors; bound the batches between the JVM and Python for the session, as texts are long."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    ship_package(spark)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def release() -> None:
    """Give memory that this process no longer uses back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_held: list = [None, None]


def claim(owner: Hashable, build: Callable = lambda: None):
    """What this Python worker keeps between tasks: one thing only, that of the operator that runs now.

    Workers serve one query after another; what the last operator remembered goes back to the system
    before the next one fills its own memory.
    """
    if _held[0] != owner:
        _held[:] = [None, None]
        release()
        _held[:] = [owner, build()]
    return _held[1]


class Memo(dict):
    """A bounded memo of ``compute``: two generations, the older one is dropped when the younger is full."""

    def __init__(self, compute: Callable, bound: int):
        super().__init__()
        self.compute, self.bound, self.old = compute, bound, {}

    def __missing__(self, key: Hashable):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
