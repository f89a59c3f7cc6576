"""Streams of archives: files as they arrive, with the batch parser; windows over capture times; revisits of captures
that earlier batches brought."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import revisit as R
from ..operators.parse import parse_records
from ..options import WarcOptions
from ..schema import PROFILE_IDENTICAL_1_1
from ..storage import forget


def read_archive_stream(spark: SparkSession, folder: str, options: WarcOptions | None = None, *, pattern: str = "*.warc*", max_files: int = 100) -> DataFrame:
    """Records of archive files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    return parse_records(files, "content", options, path="path")


def parse_stream(stream: DataFrame, data: str, options: WarcOptions | None = None) -> DataFrame:
    """Records of archives that arrive as a binary column of any stream."""
    return parse_records(stream, data, options)


def windowed_counts(stream: DataFrame, time: str, width: str, keys: list[str], *, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows for each window and key; state goes once the watermark has passed a window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], *, late: str = "10 minutes") -> DataFrame:
    """Rows for each session of a key: runs of events closer than the gap."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def first_captures(stream: DataFrame, time: str, keys: list[str], *, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


_REF = "profile string, target_record_id string, target_uri string, target_date string"
#: State of this kind needs this store; and with times of forgetting, batches without data would never end.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class _FirstOfPayload(StatefulProcessor):
    """Keeps what the first capture of a digest is called; gives it once for each batch that has the digest."""

    def __init__(self, keys: int, ttl_ms: int | None) -> None:
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", _REF, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.first.get() if self.first.exists() else None
        if known is None:
            least = min(rows, key=lambda r: [(v is not None, v) for v in r[1 : 1 + self.keys]])
            known = tuple(least[1 + self.keys :])
            self.first.update(known)
        else:
            for _ in rows:
                pass
            if self.ttl_ms is not None:
                self.first.update(tuple(known))
        yield Row(_pd=key[0], _ref=tuple(known))

    def close(self) -> None:
        pass


def deduplicate_stream(records: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, options: WarcOptions | None = None, *, profile: str = PROFILE_IDENTICAL_1_1, order: tuple[str, ...] = ("warc_date_raw", "record_id"), ttl_ms: int | None = None, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """A started stream that hands each batch to `write`, its repeated payloads as revisits, with the batch's number.

    The first capture of a payload is that of the earliest batch, within a batch the least by `order`; a record that
    comes late, with an earlier date than the first one written, becomes a revisit like any other, as what is written
    can't change. With ttl_ms a payload that no batch has had for that long is forgotten, and its next capture is a
    first one again. The digest is that of the WARC-Payload-Digest field; records without one stay.

    State holds four short texts a digest. Only `order` and those texts go through it, one row comes out for each digest
    of a batch, and is joined to the batch's records, so blocks don't pass Python and a hot digest is an ordinary
    skewed join. The batch lies in the checkpoint's folder between the two, where lost executors don't take it along.
    A batch that comes again after a failure has the same number: `write` must replace what it wrote under it.
    """
    spark = records.sparkSession
    d = records.withColumn("_pd", R.H.get("headers", "WARC-Payload-Digest"))
    keys = d.where(R.can_be_first()).select("_pd", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], R.create_revisit_ref(profile).alias("_r")).select("_pd", *[f"_o{i}" for i in range(len(order))], "_r.*")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    first = keys.groupBy("_pd").transformWithState(_FirstOfPayload(len(order), ttl_ms), f"_pd string, _ref struct<{_REF.replace(' string', ':string')}>", "Append", mode)
    both = d.withColumn("_record", F.lit(True)).unionByName(first.withColumn("_record", F.lit(False)), allowMissingColumns=True)

    def each(batch: DataFrame, number: int) -> None:
        staged = f"{checkpoint.rstrip('/')}-batches/{number}"
        batch.write.mode("overwrite").partitionBy("_record").parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        done = R.refer_to_first(rows.where("_record").drop("_ref", "_record"), rows.where("not _record").select("_pd", "_ref"), options)
        write(done.select(*records.columns), number)
        forget(batch.sparkSession, staged)

    before = {k: spark.conf.get(k) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        return both.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
