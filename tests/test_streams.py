"""Streams run to the end over files, and give what the batch plan gives."""

import datetime as dt
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from concordat.operators import review
from concordat.streaming import batches, leases, plans

SF = "/root/testdata/sf0.001"


def test_hourly_matches_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e = e.withColumn("ts", e.ts.cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    q = plans.hourly(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("hours")) == key(plans.hourly(e))


def test_files_arrive_once(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for n, t in (("a.txt", "x"), ("b.txt", "x"), ("c.txt", "y"), ("d.bin", "z")):
        (d / n).write_text(t)
    q = plans.arriving_files(spark, str(d), "*.txt").select("document_id").writeStream.format("memory").queryName("files").outputMode("append").start()
    q.processAllAvailable()
    (d / "e.txt").write_text("y")
    q.processAllAvailable()
    q.stop()
    assert spark.table("files").count() == 2


def test_leases_agree_with_the_batch_log(spark, tmp_path):
    """One log, in batches through the stream and whole through the queue, gives the same outcome of every event."""
    spark.conf.set(*leases.STATE_STORE)
    at = dt.datetime(2030, 1, 1)
    steps = [
        (1, "enqueue", "s", None, None, None), (1, "claim", "ann", 600, None, None), (1, "claim", "bob", 600, None, None), (1, "corrected", "ann", None, 2, '{"a":{"b":1}}'), (1, "approved", "ann", None, 2, None),
        (1, "release", "ann", None, None, None), (1, "claim", "bob", 600, None, None), (1, "approved", "bob", None, None, '{"a":{"c":2}}'), (2, "claim", "ann", 600, None, None), (2, "enqueue", "s", None, None, None),
        (2, "claim", "ann", 5, None, None), (2, "odd", "ann", None, None, None), (1, "enqueue", "s", None, None, None), (2, "claim", "ann", 20, None, None),
    ]
    rows = [(t, i, kind, who, at + dt.timedelta(seconds=i), lease, expected, corrections, 1 if i == 7 else None, False) for i, (t, kind, who, lease, expected, corrections) in enumerate(steps)]
    schema = "task long, seq long, kind string, who string, at timestamp, lease_s int, expected_version long, corrections string, errors int, misfit boolean"
    log = spark.createDataFrame(rows, schema)
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03}"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = leases.leases(source).writeStream.format("memory").queryName("leases").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 180  # timers of running leases keep the query busy: it does not end by itself
    while time.time() < until and spark.table("leases").where("kind <> 'expired'").count() < len(rows):
        time.sleep(1)
    q.stop()
    got = {(r.task, r.seq): (r.version, r.refusal) for r in spark.table("leases").where("kind <> 'expired'").collect()}
    assert got == {(r.task, r.seq): (r.version, r.refusal) for r in review.revisions(log).collect()}
    assert got[1, 7] == (None, "errors") and got[1, 2] == (None, "locked") and got[1, 4] == (None, "version") and got[2, 8] == (None, "missing")


def test_follow_stops_at_a_failure_and_resumes(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()
    for k, t in enumerate(("good", "bad", "good too")):
        (source / f"{k}.txt").write_text(t)
        os.utime(source / f"{k}.txt", (1e9 + k, 1e9 + k))
    stages, given = [], []

    def process(rows):
        text = F.col("content").cast("string")
        return rows.select(F.col("path").alias("document_id"), F.when(text == "bad", "failed").otherwise("succeeded").alias("status"), text.alias("text"))

    def run(fail_fast=True):
        files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", "1").schema("path string, modificationTime timestamp, length long, content binary").load(str(source))
        return batches.follow(files, process, out, checkpoint, fail_fast=fail_fast, on_stage=lambda *x: stages.append(x), on_result=lambda df, b: given.append((b, df.count())), name="follow")

    listener = batches.Progress()
    spark.streams.addListener(listener)
    with pytest.raises(StreamingQueryException, match="documents of batch 1 failed"):
        run().awaitTermination(300)
    assert stages == [(s, b, 1) for b in (0, 1) for s in ("read", "processed", "written")] and given == [(0, 1), (1, 1)]
    every = spark.read.format("binaryFile").load(str(source)).select(F.col("path").alias("document_id"))
    tell = lambda: {r.status: r.n for r in batches.totals(every, batches.results(spark, out)).collect()}
    assert tell() == {"succeeded": 1, "failed": 1, "skipped": 1}
    (source / "1.txt").write_text("mended")
    os.utime(source / "1.txt", (1e9 + 1, 1e9 + 1))
    run().awaitTermination(300)
    assert tell() == {"succeeded": 3} and sorted(r.text for r in batches.results(spark, out).collect()) == ["good", "good too", "mended"]
    assert [b for _, b, _ in stages[6:]] == [1, 1, 1, 2, 2, 2]
    spark.streams.removeListener(listener)
    assert {b[1] for b in listener.batches} >= {0}
