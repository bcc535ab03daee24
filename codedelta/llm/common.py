"""Helpers shared by the pipeline operators: tables in the shared folder and small column tools."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without ASCII white space.
SPACE_CLASS = r"[ \t-\r]"
WORD_CLASS = r"[^ \t-\r]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session.  Only where none is set and Spark runs on one machine (tests) a scratch folder takes its place; elsewhere
    the driver's folder would not be the executors'."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a copy that outlives any executor, and gives Catalyst the
    real size of small tables, so that it broadcasts them only below its threshold."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch: a few MB of ordinary documents for each Python worker and its JVM side.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, function, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with batches of at most ``rows`` rows: lowers the session's limit where it is higher, since a batch
    of long texts lies in memory several times."""
    bound_batches(df.sparkSession, rows)
    return df.mapInArrow(function, schema)


def map_texts(df: DataFrame, function, schema, rows: int = BATCH_ROWS, encodes: bool = False) -> DataFrame:
    """``map_arrow`` whose tasks leave no memory behind in workers that Spark uses again: a task that encodes nothing
    (``encodes``) first drops the pieces that earlier tasks have kept, and every task ends by giving free memory back."""
    def run(batches):
        if not encodes:
            drop_encoders()
        try:
            yield from function(batches)
        finally:
            give_back()
    return map_arrow(df, run, schema, rows)


def drop_encoders() -> None:
    encoding = sys.modules.get("codedelta.llm.encoding")
    if encoding is not None:
        encoding.forget()


def give_back() -> None:
    """Return the freed memory of Arrow's pool and of the C library to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids`` (one column), with their own columns."""
    other = fresh_name(docs, "_other")
    return docs.join(ids.toDF(other), F.col("doc_id").eqNullSafe(F.col(other)), "left_anti")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst copies a column into every lambda that mentions it; a lambda variable
    bound to a one-element array is evaluated only once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that on pure ASCII texts; other texts take ``translate``."""
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def non_empty(parts: Column) -> Column:
    """The parts of a split without the empty ones at both ends."""
    return F.filter(parts, lambda w: w != F.lit(""))
