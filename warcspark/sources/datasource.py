"""The `warc` data source: spark.read.format("warc"), spark.readStream.format("warc"), df.write.format("warc").

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").option("spec", "fail").load("/archives/*.warc.gz")

Reading gives the columns of schema.FRAMED (shape them with operators.parse.typed, or use
`load`). Each file is a partition; `load` with `split_bytes` cuts files into ranges of about that size,
compressed ones too, and with the option `index` (a Parquet table of file_path,
record_offset, record_size) at record starts, of about `rangeBytes`. Cuts come to the reader as a table (option
`cuts`); the option `index` alone is read by the driver. Ranges that are small go to a task in groups, so that tasks
follow bytes and cores, however small ranges are (option `tasks`, which `load` sets). Files are read in pieces, so their size doesn't matter. Options: `offset` (start of
every file), `readBlock` (false skips blocks), `path`, `types` (record types to keep, separated by
commas), and all of WarcOptions. With `pushdown` (and spark.sql.python.filterPushdown.enabled; `load` sets
both) filters on record_type (kind), file_path and record_offset do so too, and leave out ranges.

Writing stages the files of each attempt below `_temporary` of the folder. The commit, which only
happens if all tasks have succeeded, gives them their names in one count, writes a journal and renames
them; an abort removes them, and sink.recover goes on for a driver that was lost. A stream's commit writes what it
renames into `_batches` first, under the batch's number: a batch that comes again publishes nothing twice.

A stream that reads keeps the names of all files as its offset, or with the option `seenLog` (a folder) their numbers in a
log there, so the offset stays small; `maxFilesPerTrigger` then bounds a batch (with the trigger availableNow, a run). Paths without a scheme are local ones; on a cluster give a scheme, or use
`load`, which puts them on Spark's default file system.
"""

from __future__ import annotations

import base64
import fnmatch
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.parse import batches_of, typed
from ..options import FAIL, WarcOptions
from ..schema import FRAMED
from ..storage import on_default
from .commit import attempt_folder, begin, discard, finish_moves, move_all, open_folder, read_json, record, there, write_once
from .framing import PIECE, chunks, frames
from .sink import Writer, WriterOptions, format_name
from .splits import NEAR, RawFile, index_ranges, split_ranges, stored, tasks


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return open_folder(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Files and sizes below a path, which may end in a pattern; hidden and open files are left out."""
    fs, at = file_system(path)
    if any(c in at for c in "*?["):
        top = at[: min(at.find(c) for c in "*?[" if c in at)].rpartition("/")[0] or "/"
        found = [f for f in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if fnmatch.fnmatch(f.path, at)]
    else:
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")) and not f.path.endswith(".open") and "/_" not in f.path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # records that begin before it


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: tuple[Range, ...]


def grouped(ranges: list[Range], tasks: int) -> list[Ranges]:
    """Neighbours in groups of about equal bytes, `tasks` or a few more; ranges to the end of a file, whose size isn't known, count
    as an average one. Without `tasks` each stands alone."""
    known = [r.end - r.start for r in ranges if r.end is not None]
    if not tasks or not known:
        return [Ranges((r,)) for r in ranges]
    mean = sum(known) / len(known)
    most, held, out = mean * len(ranges) / tasks, 0.0, []
    for r in ranges:
        n = mean if r.end is None else r.end - r.start
        if not out or held + n > most:
            out.append([])
            held = 0.0
        out[-1].append(r)
        held += n
    return [Ranges(tuple(g)) for g in out]


def read_range(part: Range, options: WarcOptions, *, with_block: bool, types: frozenset[str]) -> Iterator[dict]:
    raw = RawFile(part.path, part.start, PIECE if part.end is None else max(NEAR, min(PIECE, part.end - part.start)))
    try:
        for row in frames(raw, options, offset=part.start, path=part.path, with_block=with_block, types=types):
            if part.end is not None and row["record_offset"] >= part.end:
                return
            if types and row["headers"] is not None and row["kind"] not in types and not row["error"]:
                continue
            if row["error"] and FAIL in (options.syntax, options.spec):
                raise ValueError(f"{part.path} at {row['record_offset']}: {row['error']['msg']}")
            yield row
    finally:
        raw.close()


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.options = WarcOptions.from_strings(options)
        self.path = low.get("path", "")
        self.start = int(low.get("offset", "0"))
        self.with_block = low.get("readblock", "true").lower() not in ("false", "0", "no")
        self.types = frozenset(t.strip().lower() for t in low.get("types", "").split(",") if t.strip())
        # what filters leave: files, places, or nothing at all
        self.files, self.low, self.high, self.none = None, 0, None, False
        self.tasks = int(low.get("tasks", "0"))
        self.cuts, self.index, self.range_bytes = low.get("cuts"), low.get("index"), int(low.get("rangebytes", str(128 << 20)))

    def wanted(self, r: Range) -> bool:
        low_end = r.end is None or r.end > self.low
        return not self.none and (self.files is None or r.path in self.files) and low_end and (self.high is None or r.start <= self.high)

    def ranges(self) -> list[Range]:
        if self.cuts:
            fs, at = open_folder(self.cuts)
            parts = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")]
            rows = [r for f in parts for r in pq.read_table(f, filesystem=fs).to_pylist()]
            return [Range(r["path"], r["start"], r["end"]) for r in sorted(rows, key=lambda r: (r["path"], r["start"]))]
        files = list_files(self.path)
        if not self.index:
            return [Range(p, self.start, None) for p, _ in files]
        import pyarrow.dataset as ds

        # of the starts in a stretch of range_bytes only the first is kept, so memory follows the ranges, not the records
        cuts: dict[str, dict[int, int]] = {p: {} for p, _ in files}
        for b in ds.dataset(self.index).to_batches(columns=["file_path", "record_offset"]):
            for p, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p in cuts and at >= self.start:
                    k = at // self.range_bytes
                    cuts[p][k] = min(at, cuts[p].get(k, at))
        out = []
        for p, _ in files:
            begin = sorted(cuts[p].values()) or [self.start]
            out += [Range(p, a, b) for a, b in zip(begin, [*begin[1:], None], strict=True)]
        return out

    def read(self, *ranges: Range) -> Iterator[pa.RecordBatch]:
        rows = (row for r in ranges for row in read_range(r, self.options, with_block=self.with_block, types=self.types))
        yield from batches_of(rows, to_arrow_schema(FRAMED))


class _Pushing:
    """Filters that Spark hands down: those on the record type keep other blocks from being read, those on the file and on places
    leave out ranges. Spark still applies all of them to what comes out."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            at = getattr(f, "attribute", None)
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if at == ("kind",) and values is not None:
                self._r.types = frozenset(values) & self._r.types if self._r.types else frozenset(values)
                self._r.none = not self._r.types
            elif at == ("file_path",) and values is not None:
                self._r.files = values & self._r.files if self._r.files is not None else values
            elif at == ("record_offset",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual) or isinstance(f, EqualTo):
                    self._r.low = max(self._r.low, f.value)
                if isinstance(f, LessThan | LessThanOrEqual) or isinstance(f, EqualTo):
                    self._r.high = f.value if self._r.high is None else min(self._r.high, f.value)
            yield f


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._r = _Reading(options)

    def partitions(self) -> list[Ranges]:
        return grouped([r for r in self._r.ranges() if self._r.wanted(r)], self._r.tasks) or [Ranges(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self._r.read(*partition.ranges)


class WarcPushingReader(_Pushing, WarcReader):
    """Needs spark.sql.python.filterPushdown.enabled, which `load` sees to."""


def _packed(names: list[str]) -> str:
    return base64.b64encode(zlib.compress(json.dumps(sorted(names)).encode())).decode()


def _unpacked(offset: dict) -> set[str]:
    return set(json.loads(zlib.decompress(base64.b64decode(offset["files"])))) if offset.get("files") else set()


class SeenLog:
    """Names of files in the order in which they were first seen, in numbered segments of a folder.

    Each segment is written once, as a whole, before its numbers are used. When there are many, those that no batch will ask for
    become one."""

    MANY = 16

    def __init__(self, folder: str) -> None:
        self._fs, self._at = open_folder(folder)
        self._fs.create_dir(self._at, recursive=True)
        self._seen: set[str] = set()
        self.last = 0
        for path, _, end in self._segments():
            self._seen.update(read_json(self._fs, path)["names"])
            self.last = max(self.last, end)

    def _segments(self) -> list[tuple[str, int, int]]:
        """Path, and the numbers it goes from (without) and to; of two that overlap the longer one."""
        out: list[tuple[str, int, int]] = []
        for f in self._fs.get_file_info(pafs.FileSelector(self._at)):
            if (m := re.fullmatch(r"(\d+)-(\d+)\.json", f.base_name)):
                out.append((f.path, int(m[1]), int(m[2])))
        out.sort(key=lambda x: (x[1], -x[2]))
        kept: list[tuple[str, int, int]] = []
        for s in out:
            if not kept or s[1] >= kept[-1][2]:
                kept.append(s)
        return kept

    def add(self, names: list[str], most: int) -> int:
        """Takes down names that are new, `most` at most (0: all), and gives the number of the last one."""
        new = [n for n in names if n not in self._seen]
        if new := new[: most or None]:
            write_once(self._fs, f"{self._at}/{self.last:020d}-{self.last + len(new):020d}.json", {"names": new})
            self._seen.update(new)
            self.last += len(new)
        return self.last

    def between(self, start: int, end: int) -> list[str]:
        """Names with numbers after start, up to end."""
        out: list[str] = []
        for path, low, high in self._segments():
            if low < end and high > start:
                names = read_json(self._fs, path)["names"]
                out += names[max(0, start - low) : end - low]
        return out

    def compact(self, upto: int) -> None:
        old = [s for s in self._segments() if s[2] <= upto]
        if len(old) < self.MANY:
            return
        names = [n for path, _, _ in old for n in read_json(self._fs, path)["names"]]
        write_once(self._fs, f"{self._at}/{old[0][1]:020d}-{old[-1][2]:020d}.json", {"names": names})
        for path, _, _ in old:
            self._fs.delete_file(path)


class WarcStreamReader(DataSourceStreamReader):
    """New files, whatever their names and times.

    Without `seenLog` the offset is the set of all names that are there, and a file that was removed and comes back is new; with it
    a name counts once. A file that goes before its batch is read fails the batch.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self._r = _Reading(options)
        low = {k.lower(): v for k, v in options.items()}
        self._folder, self._most = low.get("seenlog"), int(low.get("maxfilespertrigger", "0"))
        if self._most and not self._folder:
            raise ValueError("maxFilesPerTrigger needs a seenLog")
        self._log: SeenLog | None = None

    def _seen(self) -> SeenLog:
        self._log = self._log or SeenLog(self._folder)
        return self._log

    def initialOffset(self) -> dict:
        return {"number": 0} if self._folder else {"files": ""}

    def latestOffset(self) -> dict:
        files = list_files(self._r.path)
        if self._folder:
            return {"number": self._seen().add([p for p, _ in files], self._most)}
        return {"files": _packed([p for p, _ in files]) if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self._folder:
            return [Range(p, self._r.start, None) for p in self._seen().between(start["number"], end["number"])]
        new = _unpacked(end) - _unpacked(start)
        if "after" in start:  # an offset of earlier versions: the greatest name that was read
            new = {p for p in new if p > start["after"]}
        if "after" in end:
            new = {p for p, _ in list_files(self._r.path) if start.get("after", "") < p <= end["after"]}
        return [Range(p, self._r.start, None) for p in sorted(new)]

    def commit(self, end: dict) -> None:
        if self._folder:
            self._seen().compact(end["number"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self._r.read(partition)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, in order, where they are staged."""

    rows: int
    files: tuple[str, ...]


class _Writing:
    """What batches and streams have in common: a file sequence for each task, of rows with version, headers and block."""

    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self._folder = low["path"]
        self._job = begin(self._folder)
        yes = lambda v: v.lower() in ("true", "1", "yes")
        self._o = WriterOptions(
            max_file_size=int(low.get("maxfilesize", 1 << 30)), compress=yes(low.get("compression", "true")), level=int(low.get("compressionlevel", -1)), ratio=float(low.get("expectedcompressionratio", 0.5)),
            flush=yes(low.get("flush", "false")), suffix=low.get("compressedfilesuffix", ".gz"), open_suffix=low.get("openfilesuffix", ".open"), prefix=low.get("prefix", ""), extension=low.get("extension", "warc"), pattern=low.get("pattern", WriterOptions.pattern), host=low.get("host"),
        ).settled()

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        staging = attempt_folder(self._job, f"{part}-{uuid.uuid4().hex}")
        # the commit gives the names; until then a number in the attempt's own folder is enough
        w, n, files = Writer(self._folder, replace(self._o, name=lambda k: f"{part}-{k}"), 0, 1, staging), 0, []
        try:
            for row in iterator:
                said = next((h["value"] for h in row["headers"] if h["name"] == "Content-Length"), "")
                length = int(said) if said.isdigit() and len(said) < 19 else None
                head = f"WARC/{row['version']}\r\n" + "".join(f"{h['name']}: {h['value']}\r\n" for h in row["headers"])
                if w.full(length):
                    files.append(w.close())
                w.write(head.encode(), bytes(row["block"] or b""), length)
                n += 1
            files.append(w.close())
        except BaseException:
            w.abort()
            discard(staging)
            raise
        return Written(n, tuple(f for f in files if f))

    def _moves(self, messages: list, after: int = 0) -> list[tuple[str, str]]:
        """Staged files and where they go, numbered on from `after`."""
        _, folder = open_folder(self._folder)
        suffix = self._o.suffix if self._o.compress else ""
        staged = [f for m in messages if m for f in m.files]
        return [(f, f"{folder}/{format_name(self._o, k)}{suffix}") for k, f in enumerate(staged, after + 1)]

    def _free(self, moves: list[tuple[str, str]]) -> None:
        fs, _ = open_folder(self._folder)
        if taken := [i.path for i in fs.get_file_info([to for _, to in moves]) if i.type != pafs.FileType.NotFound]:
            raise FileExistsError(taken[0])


class WarcWriter(_Writing, DataSourceWriter):
    def commit(self, messages: list) -> None:
        moves = self._moves(messages)
        try:
            self._free(moves)
        except FileExistsError:
            self.abort(messages)
            raise
        record(self._job, {"moves": moves})
        finish_moves(self._job)

    def abort(self, messages: list) -> None:
        """Nothing of the job is left."""
        discard(self._job)


class WarcStreamWriter(_Writing, DataSourceStreamWriter):
    """Files of each batch, published once: what a batch renames is in the log before it does so."""

    #: Batches that stay in the log; a query asks again for its last one only.
    KEPT = 100

    def commit(self, messages: list, batchId: int) -> None:
        fs, folder = open_folder(self._folder)
        log = f"{folder}/_batches"
        fs.create_dir(log, recursive=True)
        path = f"{log}/{batchId:020d}.json"
        entry = read_json(fs, path)
        if entry is None:
            before = [f.path for f in fs.get_file_info(pafs.FileSelector(log)) if re.fullmatch(r"\d{20}\.json", f.base_name) and int(f.base_name[:20]) < batchId]
            last = (read_json(fs, max(before)) or {}).get("last", 0) if before else 0
            moves = self._moves(messages, last)
            self._free(moves)
            entry = {"moves": moves, "last": last + len(moves)}
            write_once(fs, path, entry)
        if not there(fs, f"{path}.done"):
            move_all(fs, [tuple(m) for m in entry["moves"]])
            write_once(fs, f"{path}.done", {})
        self.abort(messages, batchId)  # the attempts' folders, and what a batch that came again has staged anew
        for f in fs.get_file_info(pafs.FileSelector(log)):
            if f.base_name[:20].isdigit() and int(f.base_name[:20]) < batchId - self.KEPT:
                fs.delete_file(f.path)

    def abort(self, messages: list, batchId: int) -> None:
        for folder in {f.rpartition("/")[0] for m in messages if m for f in m.files}:
            discard(folder)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return FRAMED

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (WarcPushingReader if options.get("pushdown", "false").lower() == "true" else WarcReader)(options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return WarcStreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives can only be added: use mode append")
        return WarcWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return WarcStreamWriter(dict(self.options))


def load(spark: SparkSession, path: str, options: WarcOptions | None = None, *, split_bytes: int | None = None, **more: str) -> DataFrame:
    """Records of files by the data source, with all columns. With split_bytes a file is read in ranges of about that
    size, with the option `index` in ranges of `rangeBytes`; both are worked out by a Spark job first."""
    spark.dataSource.register(WarcDataSource)
    o, path = options or WarcOptions(), on_default(spark, path)
    low = {k.lower(): k for k in more}
    begin = int(more.get(low.get("offset"), "0"))
    if split_bytes or "index" in low:
        files = list_files(path)
        if split_bytes:
            more["cuts"] = stored(split_ranges(spark, files, o, begin=begin, split=split_bytes))
        else:
            size = int(more.get(low.get("rangebytes"), str(128 << 20)))
            more["cuts"] = stored(index_ranges(spark, files, spark.read.parquet(more.pop(low["index"])), begin=begin, split=size))
        more.setdefault("tasks", str(tasks(spark, sum(n for _, n in files))))
    given = {k: str(getattr(o, k)) for k in ("syntax", "spec", "unknown_type", "max_block_bytes")}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    more.setdefault("pushdown", "true")
    return typed(spark.read.format("warc").options(**given, **more).load(path), o)


def block_chunks(records: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The blocks of records of any size, given by file_path and record_offset: file_path, record_offset, number (from 0),
    chunk_offset and data of each piece. A task holds one piece at a time; a record is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_path", "record_offset", "number", "chunk_offset", "data"]
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = RawFile(path, at)
                try:
                    for k, piece in enumerate(chunks(raw, chunk_bytes)):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([k], pa.int64()), pa.array([k * chunk_bytes], pa.int64()), pa.array([piece], pa.binary())], names)
                finally:
                    raw.close()

    return records.select("file_path", F.col("record_offset").cast("long")).mapInArrow(run, "file_path string, record_offset long, number long, chunk_offset long, data binary")
