"""A sorted index of captures: which record of a URL, or of a host, is nearest to a time, and reading just that one.

Keys begin with the host's labels in reverse, so a domain's captures are neighbours. The index is dealt in ranges
of key and time, sorted within them, and kept as Parquet: the files' own ranges rule out what a look-up by key or key prefix doesn't
need. The capture nearest to a time is the nearer of the last one not later and the first one not earlier, which two as-of
passes find; both deal rows by key and day, so a hot key spreads. Captures are then read from their places, with no other record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..options import WarcOptions
from ..schema import FRAMED
from ..sources.framing import frames
from ..sources.splits import Window
from .analytics import as_of
from .parse import batches_of, typed

#: Bytes of a file whose places one task reads.
STRETCH = 8 << 20
INDEX = ["key", "captured", "file_path", "record_offset", "record_size", "record_type", "record_id", "target_uri", "payload_digest"]


def host_key(uri: Column | str) -> Column:
    """The labels of the host in reverse, with commas, and a closing bracket: org,example,www) - '' where there is no host."""
    host = F.lower(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.\-]*+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"))).otherwise(F.lit(""))


def url_key(uri: Column | str) -> Column:
    """The host's key, then path and query as they are; the fragment doesn't count."""
    rest = F.regexp_extract(uri, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*+://[^/?#]*([^#]*)", 1)
    return F.concat(host_key(uri), F.when(rest == "", "/").otherwise(rest))


def write_index(records: DataFrame, path: str, *, key: Column | None = None, partitions: int | None = None, types: tuple[str, ...] = ("response", "resource", "revisit")) -> DataFrame:
    """Writes the index of records of these types, by URL unless `key` says otherwise, and reads it back. Records without a
    time or a place are left out, as nothing could find them."""
    d = records.where(F.col("record_type").isin(*types) & F.col("warc_date").isNotNull() & F.col("record_offset").isNotNull())
    d = d.select(F.coalesce(url_key("target_uri") if key is None else key, F.lit("")).alias("key"), F.col("warc_date").alias("captured"), *INDEX[2:])
    order = ["key", "captured", "file_path", "record_offset"]
    dealt = d.repartitionByRange(partitions, *order) if partitions else d.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(path)
    return records.sparkSession.read.schema(d.schema).parquet(path)


def under(index: DataFrame, domain: str) -> DataFrame:
    """Captures of a domain and its subdomains, as a range of keys."""
    low = ",".join(reversed(domain.lower().split(".")))
    return index.where(((F.col("key") >= low + ")") & (F.col("key") < low + "*")) | ((F.col("key") >= low + ",") & (F.col("key") < low + "-")))


def nearest(asks: DataFrame, index: DataFrame, *, key: str = "key", time: str = "time") -> DataFrame:
    """asks with the place of the capture of their key that is nearest in time, as struct `capture` (null: there is none).

    Of two that are equally near the earlier one counts, of several at one time the last by file and place.
    """
    place = [c for c in INDEX if c != "key"]
    micros = F.unix_micros("captured")
    found = index.select(F.col("key").alias("_key"), micros.alias("_up"), (-micros).alias("_down"), F.struct(*place).alias("_place"))
    at = F.unix_micros(F.col(time))
    d = asks.withColumn("_up_ask", at).withColumn("_down_ask", -at)
    day = lambda t: F.floor(t / F.lit(86_400_000_000))
    for way in ("up", "down"):
        d = as_of(d, found, by="_key", left_by=key, left_time=f"_{way}_ask", right_time=f"_{way}", value="_place", out=f"_{way}_place", bucket=day)
    before, after = F.col("_up_place"), F.col("_down_place")
    nearer = F.when(after.isNull() | (F.col("_up_ask") - F.unix_micros(before["captured"]) <= F.unix_micros(after["captured"]) - F.col("_up_ask")), before).otherwise(after)
    return d.select(*asks.columns, F.when(before.isNull(), after).otherwise(nearer).alias("capture"))


def read_at(spark: SparkSession, places: DataFrame, options: WarcOptions | None = None) -> DataFrame:
    """The records at places (file_path, record_offset), each by itself, with all columns. Places are dealt by stretches
    of the files and read in order, so those that are near come from one piece of a file."""
    options = options or WarcOptions()
    plain, schema = options.but(record_id=None), to_arrow_schema(FRAMED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            raw: Window | None = None
            try:
                for b in batches:
                    for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        if raw is None or raw.path != path:
                            if raw:
                                raw.close()
                            raw = Window(path)
                        raw.seek(at)
                        yield from frames(raw, plain, offset=at, path=path, one=True)
            finally:
                if raw:
                    raw.close()

        return batches_of(rows(), schema)

    wanted = places.where("file_path is not null and record_offset is not null").select("file_path", F.col("record_offset").cast("long"))
    dealt = wanted.repartition("file_path", F.floor(F.col("record_offset") / STRETCH))
    return typed(dealt.sortWithinPartitions("file_path", "record_offset").mapInArrow(run, FRAMED), options)
