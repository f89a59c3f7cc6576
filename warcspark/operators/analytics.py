"""Queries over records that an archive's users otherwise loop for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fields as H


def index(records: DataFrame) -> DataFrame:
    """One row for each record: where it is, and what it holds. Feeds the data source's option `index`."""
    return records.select("file_path", "record_offset", "record_size", "record_type", "record_id", "target_uri", "warc_date_raw", "payload_digest")


def of_types(records: DataFrame, *types: str) -> DataFrame:
    """Records of any of the types, by one test of their bits."""
    from ..schema import RECORD_TYPES

    mask = 0
    for t in types:
        mask |= RECORD_TYPES[t]
    return records.where(F.col("record_type_code").bitwiseAND(mask) != 0)


def as_of(left: DataFrame, right: DataFrame, *, by: str, left_time: str, right_time: str, value: str, out: str, left_by: str | None = None, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the value of the latest right row of the same key that is not later, null where there is none.

    One shuffle by key of both sides together and one ordered pass, with no join of rows; ties of time count as not
    later, and of right rows with one time the greatest value counts. With `bucket`, a rising function of time (such as
    its day), rows are dealt by key and bucket, so a hot key spreads; the value that each bucket begins with comes from
    a table with a row for each key and bucket.
    """
    cols = left.columns
    at = bucket or (lambda t: F.lit(0))
    mine = left.select(*cols, F.lit(1).alias("_side"), F.col(left_time).alias("_t"), F.col(left_by or by).alias("_k"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    theirs = right.where(F.col(right_time).isNotNull()).select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("_side"), F.col(right_time).alias("_t"), F.col(by).alias("_k"), F.col(value).alias("_v"))
    both = mine.unionByName(theirs).withColumn("_b", at(F.col("_t")))
    if bucket:
        last = both.groupBy("_k", "_b").agg(F.max(F.when((F.col("_side") == 0) & F.col("_v").isNotNull(), F.struct("_t", "_v")))["_v"].alias("_last"))
        before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        carry = last.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
        both = both.join(carry, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_b").eqNullSafe(F.col("_b2")))
    else:
        both = both.withColumn("_carry", F.lit(None).cast(right.schema[value].dataType))
    w = W.partitionBy("_k", "_b").orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(w), "_carry")).where("_side = 1").select(*cols, out)


def interval_join(left: DataFrame, right: DataFrame, *, at: str, start: str, end: str, bin: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left with each row of right whose interval [start, end) holds left's `at`; all three are numbers.

    An equi-join on bins of width `bin`: a row of right stands in each bin that it meets, a row of left in one, so no
    pair comes twice and adaptive execution can split hot bins. Intervals that are empty or null match nothing.
    """
    clash = sorted(set(left.columns) & set(right.columns) - set(on))
    if clash:
        raise ValueError(f"both sides have columns {', '.join(clash)}")

    def number(c: str) -> Column:
        return F.floor(F.col(c) / bin).cast("long")

    # the last bin is that of the greatest value below the end
    last = F.when(F.pmod(F.col(end), F.lit(bin)) == 0, number(end) - 1).otherwise(number(end))
    wide = right.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(number(start), F.greatest(last, number(start)))))
    got = left.withColumn("_bin", number(at)).join(wide, [*on, "_bin"])
    return got.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def host(uri: Column | str) -> Column:
    """Host of a URI, in lower case; null if it has none."""
    found = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(found != "", F.lower(found))


def running_offsets(records: DataFrame, size: Column, *, file: list[str], order: list[str]) -> DataFrame:
    """records with the byte place of each in its file, were they written one after the other."""
    w = W.partitionBy(*file).orderBy(*order).rowsBetween(W.unboundedPreceding, -1) if file else W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("record_offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def segment_findings(records: DataFrame) -> DataFrame:
    """origin_id, kind, first and last (segment numbers, or lengths said and found) of what is wrong with segmented records.

    missing: numbers between two segments, or before the first one, that no record has; repeated: a number that several have;
    unnumbered_origin: continuations whose first record isn't there, or says no number; no_total and total_length: the last
    segment says no total length, or not the sum of the lengths found (looked at where no number is missing or repeated).
    Only headers are looked at: a row for each segment with its number and length, no blocks, and no group of them in one row, so
    records of any number of segments are judged; windows are by origin, and origins are as many as segmented records.
    """
    n, length = H.get_int("headers", "WARC-Segment-Number"), H.get_int64("headers", "Content-Length")
    own, origin = H.get_id("headers", "WARC-Record-ID"), H.get_id("headers", "WARC-Segment-Origin-ID")
    part = n.isNotNull() | (F.col("record_type") == "continuation")
    d = records.where(part).select(F.coalesce(origin, own).alias("origin_id"), n.alias("n"), length.alias("length"), H.get_int64("headers", "WARC-Segment-Total-Length").alias("total"))
    counts = d.groupBy("origin_id", "n").agg(F.count(F.lit(1)).alias("copies"), F.sum("length").alias("length"), F.max("total").alias("total"))
    order = W.partitionBy("origin_id").orderBy(F.col("n").asc_nulls_first())
    seen = counts.withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0)))
    no = F.lit(None).cast("long")

    def rows(which: DataFrame, kind: str, first: Column, last: Column) -> DataFrame:
        return which.select("origin_id", F.lit(kind).alias("kind"), first.cast("long").alias("first"), last.cast("long").alias("last"))

    numbered = seen.where("n is not null")
    out = rows(numbered.where("n > before + 1"), "missing", F.col("before") + 1, F.col("n") - 1)
    out = out.unionByName(rows(counts.where("n is not null and copies > 1"), "repeated", F.col("n"), F.col("n")))
    whole = counts.groupBy("origin_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("n").alias("numbers"), F.sum("copies").alias("copies"), F.sum("length").alias("sum"), F.max_by("total", F.coalesce("n", F.lit(0))).alias("total"), F.count_if(F.col("n").isNull()).alias("odd"))
    out = out.unionByName(rows(whole.where("odd > 0 or low > 1"), "unnumbered_origin", F.col("low"), F.col("high")))
    sound = whole.where("odd = 0 and low = 1 and numbers = high and copies = high and high > 1")
    out = out.unionByName(rows(sound.where("total is null"), "no_total", no, F.col("sum")))
    return out.unionByName(rows(sound.where("total <> sum"), "total_length", F.col("total"), F.col("sum")))


def segment_digests(records: DataFrame, algorithm: str = "sha1") -> DataFrame:
    """origin_id, segments, size, digest (base16) of the blocks of each segmented record in the order of their numbers, and
    said, the payload digest field of its first segment.

    Segments are dealt by origin and sorted; a task carries one hash along and holds a batch of blocks, however many segments a
    record has.
    """
    n = H.get_int("headers", "WARC-Segment-Number")
    origin = F.coalesce(H.get_id("headers", "WARC-Segment-Origin-ID"), H.get_id("headers", "WARC-Record-ID"))
    d = records.where(n.isNotNull()).select(origin.alias("origin_id"), n.alias("n"), H.get("headers", "WARC-Payload-Digest").alias("said"), F.coalesce("block", F.lit(b"")).alias("block"))
    names = ["origin_id", "segments", "size", "digest", "said"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # origin, segments, size, hash, said

        def batch(done: list[list]) -> pa.RecordBatch:
            rows = [(o, k, size, h.hexdigest(), said) for o, k, size, h, said in done]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for b in batches:
            done = []
            for i in range(b.num_rows):
                o, said, block = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_buffer()
                if now is None or o != now[0]:
                    done += [now] if now else []
                    now = [o, 0, 0, hashlib.new(algorithm), said]
                now[1], now[2] = now[1] + 1, now[2] + block.size
                now[3].update(block)
            if done:
                yield batch(done)
        if now:
            yield batch([now])

    return d.repartition("origin_id").sortWithinPartitions("origin_id", "n").select("origin_id", "said", "block").mapInArrow(run, "origin_id string, segments long, size long, digest string, said string")


def join_segments(records: DataFrame) -> DataFrame:
    """Segmented records put together: origin id, number of segments, and the block.

    A record's segments are few; rows of one origin meet in one group.
    """
    n = H.get_int("headers", "WARC-Segment-Number")
    d = records.where(n.isNotNull()).select(F.coalesce(H.get_id("headers", "WARC-Segment-Origin-ID"), H.get_id("headers", "WARC-Record-ID")).alias("origin_id"), n.alias("n"), "block", H.get_int64("headers", "WARC-Segment-Total-Length").alias("total"))
    g = d.groupBy("origin_id").agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("s"), F.max("total").alias("total_length"))
    whole = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), ""))
    return g.select("origin_id", F.size("s").alias("segments"), "total_length", whole.alias("block"))
