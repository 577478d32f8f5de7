"""The state of every harvest as its reports come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from followgraph import schemas

_STATE = "at timestamp, added bigint, expected bigint, error string, reports bigint, stalled boolean"
OUTPUT = "alias string, logged_at timestamp, reports bigint, added bigint, expected bigint, error string, stalled boolean"


def _later(one: tuple, other: tuple) -> bool:
    """Whether a report (time, added, ...) counts before another: the later, of the same time the one that added more."""
    return (one[0], -1 if pd.isna(one[1]) else one[1]) > (other[0], -1 if pd.isna(other[1]) else other[1])


def follow_harvests(log: DataFrame, stalled_after: str = "1 hour") -> DataFrame:
    """A row for each alias of each batch that had reports of it: the last report so far and the number of reports.

    ``log`` is a stream of harvest reports. Reports may come in any order; those that are later than ``stalled_after`` behind the newest one are
    dropped, and a harvest without a report for as long gets one more row, with ``stalled``. The state is one report for each alias, kept by Spark;
    a hot alias' reports are cut to the last one and a count for each batch and task before they meet.
    """
    seconds = F.expr(f"INTERVAL {stalled_after}")
    milliseconds = int(log.sparkSession.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + seconds)).head()[0]) * 1000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if best is None or best[5]:
                return
            best = (*best[:5], True)
        else:
            for rows in batches:
                for row in rows.itertuples(index=False):
                    report = (row.logged_at.to_pydatetime(), row.added, row.expected, row.error)
                    reports = (best[4] if best else 0) + 1
                    best = (*(report if best is None or _later(report, best) else best[:4]), reports, False)
            if best is None:
                return
        plain = tuple(None if pd.isna(v) else int(v) if k in (1, 2, 4) else v for k, v in enumerate(best))
        state.update(plain)
        if not plain[5]:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pd.Timestamp(plain[0]).timestamp() * 1000) + milliseconds))
        columns = ["logged_at", "added", "expected", "error", "reports", "stalled"]
        frame = pd.DataFrame([plain], columns=columns).assign(alias=key[0])
        frame = frame.astype({"added": "Int64", "expected": "Int64", "reports": "Int64", "error": "object"})
        yield frame[["alias", "logged_at", "reports", "added", "expected", "error", "stalled"]]

    reports = log.select("alias", "logged_at", "added", "expected", "error").withWatermark("logged_at", stalled_after)
    return reports.groupBy("alias").applyInPandasWithState(update, OUTPUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.HARVEST_LOG).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_progress(progress: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of every batch with the batch's number; a batch that runs again overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    stream = progress.writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def harvest_state(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of each alias, with the columns of ``activity.harvest_completeness`` and whether it stalled."""
    rows = spark.read.schema(f"{OUTPUT}, batch_id bigint").option("basePath", table).parquet(table)
    last = F.max_by(F.struct("logged_at", "reports", "added", "expected", "error", "stalled"), F.struct("batch_id", "reports", "stalled"))
    return rows.groupBy("alias").agg(last.alias("r")).select(
        "alias", "r.logged_at", "r.reports", "r.added", "r.expected",
        F.try_divide(F.col("r.added"), F.col("r.expected")).alias("ratio"),
        F.col("r.error").alias("error"), F.col("r.error").isNotNull().alias("failed"), "r.stalled",
    )
