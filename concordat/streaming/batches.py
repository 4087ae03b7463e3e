"""Documents from a stream, batch by batch: results written once, callbacks for stages and results, and a stop at the first failure.

Every micro-batch is written under its number, so one that is run again after a lost driver
replaces what it wrote before. With ``fail_fast`` a batch with a failed document is written,
told to the callbacks, and stops the query without being committed: started again, the query
begins with this batch, whose document may be mended by then. What a stopped query has not
reached counts as skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

FAILED = "failed"


class StoppedAtFailure(RuntimeError):
    """A document of the batch failed and the caller asked to stop there."""


def follow(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, fail_fast: bool = False,
    on_stage: Callable[[str, int, int], None] | None = None, on_result: Callable[[DataFrame, int], None] | None = None, name: str | None = None,
) -> StreamingQuery:
    """Start ``process`` over all that ``stream`` has now; it gives document_id, status and any columns of a result.

    ``on_stage(stage, batch, rows)`` is called as a batch enters and leaves each stage (read, processed, written), ``on_result(results,
    batch)`` with the written rows of each batch. A callback that raises stops the query like a failure of its own.
    """

    def tell(stage: str, batch: int, rows: int) -> None:
        if on_stage is not None:
            on_stage(stage, batch, rows)

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        at = f"{out}/batch={batch}"
        if on_stage is not None:
            tell("read", batch, rows.count())
        process(rows).write.mode("overwrite").parquet(at)
        done = spark.read.parquet(at)
        counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
        tell("processed", batch, sum(counts.values()))
        if on_result is not None:
            on_result(done, batch)
        tell("written", batch, sum(counts.values()))
        if fail_fast and counts.get(FAILED):
            raise StoppedAtFailure(f"{counts[FAILED]} documents of batch {batch} failed")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """What all batches have written, a document once: in the latest batch that has it."""
    found = spark.read.parquet(out)
    return found.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "document_id"]), "batch").alias("r")).select("document_id", "r.*")


def totals(sources: DataFrame, done: DataFrame) -> DataFrame:
    """(status, n) over the documents of ``sources``; those without a result are skipped."""
    left = sources.select("document_id").distinct().join(done.select("document_id", "status"), "document_id", "left")
    return left.groupBy(F.coalesce("status", F.lit("skipped")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


class Progress(StreamingQueryListener):
    """Rows and seconds of every batch of the queries of a session, and how each ended."""

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, float]] = []
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception
