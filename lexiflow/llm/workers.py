"""What Python workers hold while and after they run a task.

Spark uses a Python worker again for later tasks of any step, so what one step
keeps, and memory that its libraries hold for reuse, would stay on top of what
the next steps need.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch within ``small_batches``; a longer text is a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: One step's state at a time.
_HELD: dict[Hashable, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def held(key: Hashable, make: Callable[[], object]) -> object:
    """State that this worker keeps for the next task of the same step."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _start(keeps: bool) -> None:
    if not keeps:
        _HELD.clear()


def _give_back() -> None:
    """Memory that Arrow's pool and the C library hold for reuse goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInPandas`` or ``mapInArrow``, without what other steps
    left in the worker (``keeps``: the step uses ``held`` itself), and with
    unused memory given back when the task ends."""
    def task(batches: Iterator) -> Iterator:
        _start(keeps)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside hand rows to Python in batches of at most BATCH;
    what the session sets itself stays.  Nothing lazy may leave the block."""
    made = [name for name in BATCH if spark.conf.get(name, None) is None]
    for name in made:
        spark.conf.set(name, BATCH[name])
    try:
        yield
    finally:
        for name in made:
            spark.conf.unset(name)
