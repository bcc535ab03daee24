"""Structured Streaming versions of the intake and status operators.

* ``analysis_stream`` (R1): new code pairs landing as parquet are analysed per
  micro-batch with the same batch transform (``foreachBatch``); each batch
  owns one folder of the parquet sink, so a batch that is run again replaces its
  rows; the checkpoint makes a restarted query resume after the last
  committed batch.
* ``dedup_submissions`` (R2): one row per pair id within the watermark.
* ``over_limit_stream`` (R3): keys above the request limit per tumbling window.
* ``latest_status_stream`` (R4): latest status per analysis (update mode); with ``expire`` the
  state of an analysis goes once the watermark has passed a window after its last event.

Event times in the driver tables are ``timestamp_ntz``; watermarks need
``timestamp``, so sources cast first (session time zone UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codedelta.operators import report as REP
from codedelta.operators import store as ST
from codedelta.rules import RATE_LIMIT_MAX, RATE_LIMIT_WINDOW


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def analysis_stream(spark: SparkSession, pairs_stream: DataFrame, sink_path: str, checkpoint: str,
                    available_now: bool = True):
    """Analyse each micro-batch of code pairs and append the flat report."""
    from codedelta.plans.q_report import full_report_flat

    def run(batch: DataFrame, batch_id: int) -> None:
        # A batch that runs again after a failure replaces its own folder.
        out = full_report_flat(REP.analyze(batch.sparkSession, batch))
        out.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    w = pairs_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def dedup_submissions(submissions: DataFrame, key: str = "pair_id", ts: str = "submitted_at",
                      delay: str = "1 hour") -> DataFrame:
    s = submissions.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need TIMESTAMP
    return s.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def over_limit_stream(requests: DataFrame, key: str = "user_id", ts: str = "ts",
                      limit: int = RATE_LIMIT_MAX, window: str = RATE_LIMIT_WINDOW,
                      delay: str = "15 minutes") -> DataFrame:
    """Windows are emitted once the watermark passes their end (append mode)."""
    r = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return ST.over_limit(r, key, ts, window, limit)


def latest_status_stream(events: DataFrame, expire: str | None = None) -> DataFrame:
    """Latest status per analysis; run with outputMode('update') or 'complete'.

    ``expire``: sessions of an analysis end after such a gap in its events; ended sessions leave the state (each
    session then has its own row; use 'append' or 'update')."""
    se = ST.status_events_from(events)
    if expire is None:
        return ST.latest_status(se)
    last = F.struct("ts", "seq")
    return (se.withWatermark("ts", expire).groupBy("analysis_id", F.session_window("ts", expire).alias("w"))
            .agg(F.max_by("status", last).alias("status"), F.max("ts").alias("last_ts"))
            .select("analysis_id", "status", "last_ts"))
