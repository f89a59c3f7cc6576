"""Cutting archives into ranges without an index, at the places where reading them in one go finds records.

A file is cut into stretches of equal size. A task for each stretch guesses the first record that starts in it (a gzip member that
inflates to a version line, or a version line after a line feed) and walks on from there, without keeping blocks, to the
first record that starts beyond the stretch. A guess may be wrong: an archive within a record's block looks the same. So the walks of a
file are chained: the first stretch is known to be right; where the next one's guess is the place where the walk before it ended, it is
right as well; where it isn't, that stretch is walked again from the right place. What comes out is ranges that together give
the rows that one reader would give, the garbage between records and the row of a fatal error included, after which nothing is read.

Walking inflates and skips, which takes a small part of the time that parsing takes. Only a file's chain is in one task:
a row for each of its stretches, and those bytes whose guess was wrong.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import WarcOptions
from ..storage import scratch
from .commit import open_folder
from .framing import PIECE, frames

SPLIT_BYTES = 128 << 20
#: The least that is read at once.
NEAR = 1 << 16
#: Bytes of a member that are looked at to see whether it inflates to a version line.
_PROOF = 1 << 16
#: How members and version lines begin.
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."


class RawFile:
    """A file of any store from some place on, in pieces of `most` bytes."""

    def __init__(self, path: str, start: int, most: int = PIECE) -> None:
        fs, at = open_folder(path)
        self._in, self._most = fs.open_input_file(at), most
        self._in.seek(min(start, self._in.size()))

    def read(self, n: int) -> bytes:
        return self._in.read(min(n, self._most))

    def close(self) -> None:
        self._in.close()


class Window:
    """A file that is read from one place after the other, mostly forward: places that are near share a piece."""

    def __init__(self, path: str) -> None:
        fs, at = open_folder(path)
        self.path, self._in = path, fs.open_input_file(at)
        self._data, self._base, self._at, self._size = b"", 0, 0, self._in.size()

    def seek(self, place: int) -> None:
        end = self._base + len(self._data)
        if not self._base <= place <= (end if end >= self._size else max(self._base, end - 2 * NEAR)):
            self._load(place, PIECE if self._base <= place <= end + NEAR else 2 * NEAR)
        self._at = place

    def _load(self, place: int, n: int) -> None:
        self._in.seek(min(place, self._size))
        self._data, self._base = self._in.read(n), place

    def read(self, n: int) -> bytes:
        if self._at >= self._size:
            return b""
        if not self._base <= self._at < self._base + len(self._data):
            self._load(self._at, PIECE)
        k = self._at - self._base
        out = self._data[k : k + min(n, NEAR)]
        self._at += len(out)
        return out

    def close(self) -> None:
        self._in.close()


def _is_start(data: bytes, at: int) -> bool:
    if data.startswith(_VERSION, at):
        return at == 0 or data[at - 1 : at] == b"\n"
    try:
        return zlib.decompressobj(31).decompress(data[at : at + _PROOF], len(_VERSION)).startswith(b"WARC/")
    except zlib.error:
        return False


def guess(path: str, begin: int, end: int) -> int | None:
    """The first place from begin on, and before end, where a record seems to start."""
    raw = RawFile(path, begin)
    size = min(PIECE, max(end - begin, 1 << 12))
    try:
        data, base, over = b"", begin, False
        while base < end:
            while not over and len(data) < size + _PROOF:
                piece = raw.read(size)
                over = not piece
                data += piece
            at = -1
            while True:
                places = [p for p in (data.find(_MEMBER, at + 1), data.find(_VERSION, at + 1)) if p >= 0]
                at = min(places, default=-1)
                if at < 0 or base + at >= end or (at >= size and not over):
                    break
                if _is_start(data, at):
                    return base + at
            if over:
                return None
            data, base = data[size - 1 :], base + size - 1  # with the byte before the next place
        return None
    finally:
        raw.close()


def walk(path: str, begin: int, until: int, options: WarcOptions) -> tuple[int, int | None, bool]:
    """From a place where reading can go on: where it goes on after the last record that starts before `until`, where the next one
    starts (None: nowhere), and whether an error ends the file before that."""
    raw, resume = RawFile(path, begin, max(NEAR, min(PIECE, until - begin))), begin
    try:
        for row in frames(raw, options, offset=begin, path=path, with_block=False):
            if row["record_offset"] >= until:
                return resume, row["record_offset"], False
            if row["error"]:
                return resume, None, True
            resume = row["record_offset"] + row["record_size"]
        return resume, None, False
    finally:
        raw.close()


def chain(path: str, begin: int, split: int, walks: list[tuple[int, int | None, int, int | None, bool]], options: WarcOptions) -> list[tuple[int, int | None]]:
    """The file's ranges, from its walks (number, guess, resume, next, failed) in order; the first began at `begin`."""
    out: list[tuple[int, int | None]] = []
    at: tuple[int, int | None, bool] = (begin, begin, False)
    for number, first, *walked in walks:
        resume, start, failed = at
        if failed or start is None:
            break
        until = (number + 1) * split
        if start >= until:
            continue
        at = tuple(walked) if first == start else walk(path, resume, until, options)
        out.append((resume, at[1]))
    return out


def tasks(spark: SparkSession, size: int) -> int:
    """Tasks for so many bytes: a few for each core, and none with much more than SPLIT_BYTES."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES))


def split_ranges(spark: SparkSession, files: list[tuple[str, int]], options: WarcOptions | None = None, *, begin: int = 0, split: int = SPLIT_BYTES) -> DataFrame:
    """path, start and end (null: to the end) of the ranges of files, given with their sizes."""
    options = (options or WarcOptions()).but(record_id=None)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = begin if k == begin // split else guess(path, k * split, (k + 1) * split)
                rows.append((path, k, first, *(walk(path, first, (k + 1) * split, options) if first is not None else (None, None, None))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "k", "first", "resume", "next", "failed"])

    def join(mine: pa.Table) -> pa.Table:
        rows = sorted((r["k"], r["first"], r["resume"], r["next"], r["failed"]) for r in mine.to_pylist())
        path = mine["path"][0].as_py()
        got = chain(path, begin, split, rows, options)
        return pa.table({"path": pa.array([path] * len(got), pa.string()), "start": pa.array([g[0] for g in got], pa.int64()), "end": pa.array([g[1] for g in got], pa.int64())})

    named = spark.createDataFrame([(p, n) for p, n in files if n > begin], "path string, size long")
    parts = named.select("path", F.explode(F.sequence(F.lit(begin // split), F.floor((F.col("size") - 1) / split))).alias("k"))
    n = sum(-(-max(0, size - begin) // split) + 1 for _, size in files)
    dealt = parts.repartition(max(1, min(n, tasks(spark, sum(size for _, size in files)))), F.xxhash64("path", "k"))
    walks = dealt.mapInArrow(look, "path string, k long, first long, resume long, next long, failed boolean")
    return walks.groupBy("path").applyInArrow(join, "path string, start long, end long")


def index_ranges(spark: SparkSession, files: list[tuple[str, int]], index: DataFrame, *, begin: int = 0, split: int = SPLIT_BYTES) -> DataFrame:
    """The same from an index (file_path, record_offset): a cut at the first record of each stretch. Only cuts leave the executors."""
    named = spark.createDataFrame(files, "path string, size long").select("path")
    firsts = index.where(F.col("record_offset") >= begin).groupBy("file_path", F.floor(F.col("record_offset") / split).alias("k")).agg(F.min("record_offset").alias("start"))
    got = named.join(firsts, F.col("path") == F.col("file_path"), "left").select("path", F.coalesce("start", F.lit(begin)).alias("start"))
    return got.withColumn("end", F.lead("start").over(W.partitionBy("path").orderBy("start")))


def stored(ranges: DataFrame) -> str:
    """Writes ranges for the data source's option `cuts`."""
    path = scratch(ranges.sparkSession, "cuts")
    ranges.write.parquet(path)
    return path
