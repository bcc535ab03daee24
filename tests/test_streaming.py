"""Streaming equals batch (availableNow)."""
import os
import tempfile

from pyspark.sql import functions as F

from codedelta.operators import store as ST
from codedelta.sources.derived import code_pairs
from codedelta.sources.tables import read_table
from codedelta.streaming import jobs


def _landed_events(spark, sf):
    """Copy events into a landing folder (a stream reads a directory)."""
    ev = read_table(spark, sf, "events")
    d = tempfile.mkdtemp(prefix="cd-ev-")
    ev.write.mode("overwrite").parquet(os.path.join(d, "events"))
    return ev, os.path.join(d, "events")


def test_latest_status_stream_equals_batch(spark, sf):
    ev, path = _landed_events(spark, sf)
    batch = {r.analysis_id: r.status for r in ST.latest_status(ST.status_events_from(ev)).collect()}
    src = spark.readStream.schema(ev.schema).parquet(path)
    name = "latest_status_test"
    q = (jobs.latest_status_stream(src).writeStream.format("memory").queryName(name)
         .outputMode("complete").trigger(availableNow=True)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cd-st-")).start())
    q.awaitTermination()
    stream = {r.analysis_id: r.status for r in spark.table(name).collect()}
    assert stream == batch


def test_analysis_stream_equals_batch(spark, sf):
    landing = tempfile.mkdtemp(prefix="cd-land-")
    pairs = code_pairs(spark, sf).limit(40)
    pairs.write.mode("overwrite").parquet(os.path.join(landing, "in"))
    src = spark.readStream.schema(pairs.schema).parquet(os.path.join(landing, "in"))
    sink = os.path.join(landing, "out")
    q = jobs.analysis_stream(spark, src, sink, os.path.join(landing, "ckpt"))
    q.awaitTermination()
    got = spark.read.parquet(sink).drop("batch_id")
    from codedelta.operators import report as REP
    from codedelta.plans.q_report import full_report_flat
    want = full_report_flat(REP.analyze(spark, spark.read.parquet(os.path.join(landing, "in"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_dedup_and_rate_limit_stream(spark, sf):
    ev, path = _landed_events(spark, sf)
    src = spark.readStream.schema(ev.schema).parquet(path)
    q = (jobs.over_limit_stream(src, limit=1).writeStream.format("memory").queryName("ol_test")
         .outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="cd-ol-")).start())
    q.awaitTermination()
    batch = ST.over_limit(ev.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "15 minutes", 1)
    # Windows that the watermark has not passed at the end of the input are not emitted in append mode.
    last = ev.agg(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 30 MINUTES")).first()[0]
    got = {(r.user_id, r.window_start, r.n) for r in spark.table("ol_test").collect()}
    want = {(r.user_id, r.window_start, r.n) for r in batch.collect()}
    assert got <= want and {w for w in want if w[1] < last} <= got and got


def test_dedup_stream_keeps_one_row_per_pair(spark, sf):
    d = tempfile.mkdtemp(prefix="cd-dup-")
    pairs = code_pairs(spark, sf).select("pair_id", "submitted_at").limit(30)
    pairs.union(pairs).write.parquet(os.path.join(d, "in"))
    src = spark.readStream.schema(pairs.schema).parquet(os.path.join(d, "in"))
    q = (jobs.dedup_submissions(src).writeStream.format("memory").queryName("dedup_test").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", os.path.join(d, "ckpt")).start())
    q.awaitTermination()
    assert sorted(r.pair_id for r in spark.table("dedup_test").collect()) == sorted(r.pair_id for r in pairs.collect())


def test_status_state_expires(spark, sf):
    ev, path = _landed_events(spark, sf)
    src = spark.readStream.schema(ev.schema).parquet(path)
    q = (jobs.latest_status_stream(src, expire="2 hours").writeStream.format("memory").queryName("expired_test")
         .outputMode("append").trigger(availableNow=True).option("checkpointLocation", tempfile.mkdtemp(prefix="cd-ex-")).start())
    q.awaitTermination()
    left = q.lastProgress.stateOperators[0].numRowsTotal
    assert spark.table("expired_test").count() > 0 and left < ev.count()
