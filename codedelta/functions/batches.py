"""Arrow batches of bounded size for the UDFs that take whole texts.

A batch of the session's default 10,000 rows holds tens of MB of ordinary texts, and many times as much once each has become a list of
Python objects.  ``bound_batches`` lowers the session's limits by rows and bytes; ``in_pieces`` works an input batch off in slices of
bounded bytes and sends each slice's result on before the next, so that a worker holds the objects of a few texts only (one text is
never cut)."""

from __future__ import annotations

import ctypes
import gc
import re

import pyarrow as pa
import pyarrow.compute as pc

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Text bytes of a slice.
PIECE_BYTES = 1 << 17


_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}


def bound_batches(spark, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's limits of an Arrow batch where they are higher."""
    for name, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(name).lower())
        if not now or not 0 < int(now[1]) << _UNITS[now[2]] <= limit:
            spark.conf.set(name, str(limit))


def cuts(sizes, limit: int = PIECE_BYTES):
    """(start, end) of runs of rows that reach ``limit`` bytes with their last row at the latest."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size or 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def in_pieces(batches, make, texts: int = 1):
    """``make(*columns)`` of each slice of each batch; the first ``texts`` columns are texts."""
    try:
        for columns in batches:
            sizes = [sum(x or 0 for x in row) for row in zip(*[pc.binary_length(c).to_pylist() for c in columns[:texts]])]
            for start, end in cuts(sizes):
                yield make(*[c.slice(start, end - start) for c in columns])
            if not sizes:
                yield make(*columns)
    finally:
        give_back()


def give_back() -> None:
    """Return the freed memory of Arrow's pool and of the C library to the system, so that a worker that Spark uses again starts small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def rows_of(*columns):
    """The rows of Arrow columns as Python values, one at a time."""
    for values in zip(*columns):
        yield tuple(v.as_py() for v in values)
