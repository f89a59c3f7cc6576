"""Rolling archive files from records: dealt to writers, cut by size, published once all are written.

Records are dealt to writers and put in order there; each writer keeps one file open and starts a
new one before a record that would not fit. Writers that are fewer than the shuffle partitions don't go through a task each:
tasks write ranges of a writer's order as pieces, sizes say which file each run of records belongs to and where, and the runs
are copied there, on local file systems by a task for each. Time, host and address in the names are the driver's,
so every attempt of a task makes the same names. Each attempt writes into a folder of its own
below `_temporary`; a table that only holds the rows of attempts that succeeded says what there
is. Once it is written a journal says so, and its files are renamed into place by tasks. If a task
fails for good, nothing is published; if the driver is lost after the journal, `recover` goes on. What comes back is the manifest: file, offset and
length of every record; its rows are written as they come, none are held.
"""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fields as H
from ..functions import names as N
from ..storage import on_default
from .commit import JobGone, attempt_folder, begin, discard, finish_moves, jobs, open_folder, publish, record, sync_folder, there

MANIFEST = "record_id string, file_name string, file_offset long, bytes_written long, file_size long, warcinfo_id string"


@dataclass(frozen=True)
class WriterOptions:
    max_file_size: int = 1 << 30
    compress: bool = True
    level: int = -1
    ratio: float = 0.5
    #: Puts every record on disk before the next one is written (on other stores: flushes the stream).
    flush: bool = False
    suffix: str = ".gz"
    open_suffix: str = ".open"
    prefix: str = ""
    extension: str = "warc"
    pattern: str = N.DEFAULT_PATTERN
    params: tuple[tuple[str, object], ...] = ()
    host: str | None = None
    ip: str | None = None
    time: datetime | None = None
    #: Makes the name of a file, without its suffix, from its serial number; it must always make the same.
    name: Callable[[int], str] | None = None
    #: Fields of a warcinfo record that opens every file, or what makes them from the file's name; None for no such record.
    warcinfo: tuple[tuple[str, str], ...] | Callable[[str], tuple[tuple[str, str], ...]] | None = None
    version: str = "1.1"
    before_file: Callable[[str], None] | None = None
    after_file: Callable[[str, int, str | None], None] | None = None

    def __post_init__(self) -> None:
        if not -1 <= self.level <= 9:
            raise ValueError("compression level must lie between -1 and 9")
        if not 0 < self.ratio <= 1:
            object.__setattr__(self, "ratio", 0.5)

    def settled(self) -> WriterOptions:
        """With the time, host and address of this moment and machine where none are given."""
        return replace(self, time=self.time or datetime.now(UTC), host=self.host or N.host_or_ip(), ip=self.ip or (N.outbound_ip() if "ip" in N.positional(self.pattern)[1] else ""))


def format_name(o: WriterOptions, serial: int) -> str:
    """One file name by the options' pattern."""
    if o.name:
        return o.name(serial)
    form, wanted = N.positional(o.pattern)
    time = (o.time or datetime.now(UTC)).strftime("%Y%m%d%H%M%S")
    host = o.host or N.host_or_ip()
    given = dict(o.params) | {"ts": time, "serial": serial, "prefix": o.prefix, "ext": o.extension, "ip": o.ip if o.ip is not None else N.outbound_ip() if "ip" in wanted else "", "host": o.host or N.host_name(), "hostOrIp": host}
    for k, name in enumerate(wanted, 1):
        form = form.replace(f"%{k}$", f"%({name})")
    return form % given


def estimate(length: int | None, o: WriterOptions) -> int:
    """What a record is taken to add to a file before it is written."""
    return int((length or 0) * o.ratio) if o.compress else (length or 0)


class Writer:
    """One open file after the other in a folder of any file system that Arrow knows.

    With `staging`, a folder of this attempt alone, closed files stay there until they are published; if the folder is
    gone, the job has ended, and no file is opened any more.
    """

    def __init__(self, folder: str, o: WriterOptions, number: int, writers: int, staging: str | None = None) -> None:
        self.o, self.number, self.step, self.made = o, number, writers, 0
        self.fs, self.folder = open_folder(folder)
        self.staging = open_folder(staging)[1] if staging else None
        if not staging:
            self.fs.create_dir(self.folder, recursive=True)
        self.out, self.size, self.name, self.info, self.temp = None, 0, "", None, ""

    def _open(self) -> None:
        # writers count in turns, so no two of them ever make the same name
        self.made += 1
        self.name = format_name(self.o, (self.made - 1) * self.step + self.number + 1) + (self.o.suffix if self.o.compress else "")
        path = f"{self.folder}/{self.name}"
        if self.o.before_file:
            self.o.before_file(path)
        if there(self.fs, path):
            raise FileExistsError(path)
        if self.staging and not there(self.fs, self.staging):
            raise JobGone(self.staging)
        self.temp = f"{self.staging or self.folder}/{self.name}{self.o.open_suffix}"
        local = isinstance(self.fs, pafs.LocalFileSystem)
        self.out = open(self.temp, "wb") if local else self.fs.open_output_stream(self.temp)  # noqa: SIM115
        self.size, self.info = 0, None
        if self.o.warcinfo is not None:
            self.info = f"urn:uuid:{_name_id(self.name)}"
            self._put(warcinfo_record(self.name, self.info, self.o))

    def _put(self, record: bytes) -> int:
        data = gzip.compress(record, self.o.level if self.o.level >= 0 else zlib.Z_DEFAULT_COMPRESSION, mtime=0) if self.o.compress else record
        self.out.write(data)
        if self.o.flush:
            self._sync()
        self.size += len(data)
        return len(record)

    def _sync(self) -> None:
        self.out.flush()
        if isinstance(self.fs, pafs.LocalFileSystem):
            os.fsync(self.out.fileno())

    def write(self, head: bytes, block: bytes, length: int | None) -> tuple[str, int, int, str | None]:
        """File, offset, uncompressed bytes and warcinfo id."""
        if self.full(length):
            self.close()
        if self.out is None:
            self._open()
        if self.info:
            head += f"WARC-Warcinfo-ID: <{self.info}>\r\n".encode()
        at = self.size
        n = self._put(head + b"\r\n" + block + b"\r\n\r\n")
        return self.name, at, n, self.info

    def full(self, length: int | None) -> bool:
        """Whether a record of this length starts a new file."""
        return bool(self.out is not None and length is not None and self.o.max_file_size > 0 and self.size and self.size + estimate(length, self.o) > self.o.max_file_size)

    def close(self) -> str | None:
        """Ends the file, and gives the path where it stands now."""
        if self.out is None:
            return None
        self._sync()
        self.out.close()
        self.out = None
        path = f"{self.staging or self.folder}/{self.name}"
        self.fs.move(self.temp, path)
        if not self.staging:
            sync_folder(self.fs, self.folder)
            if self.o.after_file:
                self.o.after_file(path, self.size, self.info)
        return path

    def abort(self) -> None:
        """Nothing is left of the open file, and of what is staged."""
        if self.out is not None:
            self.out.close()
            self.out = None
            if there(self.fs, self.temp):
                self.fs.delete_file(self.temp)


def _name_id(name: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def warcinfo_record(name: str, info: str, o: WriterOptions) -> bytes:
    """The record that opens a file."""
    fields = o.warcinfo(name) if callable(o.warcinfo) else o.warcinfo
    block = "".join(f"{k}: {v}\r\n" for k, v in fields or ()).encode()
    date = (o.time or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"WARC/{o.version}\r\nWARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nWARC-Record-ID: <{info}>\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def add_concurrent_to(records: DataFrame, group: str) -> DataFrame:
    """Each record of a group names every other one in WARC-Concurrent-To, in order of id.

    A group is what is written in one call, so it is small by nature.
    """
    d = records.withColumn("_id", H.get("headers", "WARC-Record-ID"))
    ids = d.groupBy(F.col(group).alias("_g")).agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    d = d.join(ids, F.col(group).eqNullSafe(F.col("_g")), "left")
    more = F.transform(F.filter("_ids", lambda x: x != F.col("_id")), lambda x: H.field("WARC-Concurrent-To", x))
    return d.withColumn("headers", F.concat("headers", F.coalesce(more, F.array().cast("array<struct<name:string,value:string>>")))).select(*records.columns)


#: Parts by hash that keys are dealt in, for each writer, and what a record's fields are taken to add to its block.
PARTS, RECORD_BYTES = 256, 512


def deal_by_bytes(records: DataFrame, key: Column, size: Column, writers: int, *, parts: int = PARTS) -> DataFrame:
    """records with `_writer` (from 0): keys fall into writers * parts parts by hash, and parts in their order go to the
    writer in whose share of all bytes their middle lies, so writers differ by a part's bytes.

    The sums of the parts, writers * parts rows at most, merge before the shuffle; a window over them gives the shares,
    and they come back as a broadcast. A key never leaves its writer, so one with more bytes than a share is a writer of its own.
    """
    n = writers * parts
    d = records.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    sums = d.groupBy("_part").agg(F.sum(size.cast("long")).alias("_bytes"))
    upto = F.sum("_bytes").over(W.orderBy("_part"))
    middle, total = upto - F.col("_bytes") / 2, F.sum("_bytes").over(W.partitionBy())
    share = F.least(F.floor(middle * writers / F.greatest(total, F.lit(1))), F.lit(writers - 1)).cast("int")
    return d.join(F.broadcast(sums.select("_part", share.alias("_writer"))), "_part").drop("_part")


#: Rows of a manifest that a task hands on at once.
ROWS = 4096
_FILES = f"{MANIFEST}, staged string"
_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def write_archives(records: DataFrame, folder: str, options: WriterOptions | None = None, *, writers: int | None = None, group: str | None = None, order: tuple[str, ...] = ("record_id",), marshaled: Callable[[], tuple[Column, Column]] | None = None, balanced: bool = False) -> DataFrame:
    """Writes records into files below folder and returns their manifest, once it is all published.

    Records of a group go to one writer, in `order`; without a group they are dealt by id. There are as many
    writers as shuffle partitions unless `writers` says otherwise, each then a task of its own. Keys are dealt by hash or, if
    `balanced`, by the bytes of their records as well, which reads the lengths once before (`deal_by_bytes`). `marshaled` gives columns to write in place of a
    record's version and fields, and of its block. The manifest itself is a table in `_manifest` of the folder, a
    row for each record.
    """
    spark = records.sparkSession
    o = (options or WriterOptions()).settled()
    writers = writers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = on_default(spark, folder)
    key = F.col(group) if group else H.get("headers", "WARC-Record-ID")
    head = F.encode(F.concat(F.lit("WARC/"), F.col("version"), F.lit("\r\n"), H.serialize("headers")), "UTF-8")
    head, block = marshaled() if marshaled else (head, F.col("block"))
    if balanced and writers > 1:
        records, writer = deal_by_bytes(records, key, F.coalesce(F.octet_length(block), F.lit(0)) + RECORD_BYTES, writers), F.col("_writer")
    else:
        writer = F.lit(0) if writers == 1 else F.pmod(F.xxhash64(key), F.lit(writers)).cast("int")
    d = records.select(writer.alias("_w"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], H.get_id("headers", "WARC-Record-ID").alias("record_id"), head.alias("head"), F.coalesce(block, F.lit(b"")).alias("block"), H.get_int64("headers", "Content-Length").alias("length"))
    where = _where(folder)
    job = begin(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Writer | None = None
        number = None
        held: list[tuple] = []
        staging = attempt_folder(job, uuid.uuid4().hex)

        def rows() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], ["record_id", "file_name", "file_offset", "bytes_written", "file_size", "warcinfo_id", "staged"])
            held.clear()
            return out

        def close() -> None:
            """A row for the file, without an offset."""
            if now and (path := now.close()):
                held.append((None, now.name, None, None, now.size, now.info, path))

        try:
            for b in batches:
                for w, rid, h, block, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if w != number:
                        close()
                        now, number = Writer(folder, o, w, writers, staging), w
                    if now.full(length):
                        close()
                    name, at, n, info = now.write(h, block, length)
                    held.append((rid, name, at, n, None, info, f"{now.staging}/{name}"))
                    if len(held) >= ROWS:
                        yield rows()
            close()
        except BaseException:
            if now:
                now.abort()
            discard(staging)
            raise
        if held:
            yield rows()

    keys = ["_w", *[f"_o{i}" for i in range(len(order))]]
    try:
        if writers < int(spark.conf.get("spark.sql.shuffle.partitions")) and o.warcinfo is None and o.before_file is None and not o.flush:
            _in_pieces(d, keys, folder, job, o, writers)
        else:
            dealt = d.repartitionById(writers, "_w").sortWithinPartitions(*keys)
            dealt.select("_w", "record_id", "head", "block", "length").mapInArrow(run, _FILES).write.parquet(f"{job}/manifest")
        record(job, {"manifest": True})
    except BaseException:
        discard(job)
        raise
    _publish_all(spark, where, job, o.after_file)
    return manifest(spark, folder)


_PIECES = "w int, part int, at long, size long, length long, record_id string, bytes_written long, piece string"
_RUNS = "w int, part int, start long, end long, number int, offset long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _in_pieces(d: DataFrame, keys: list[str], folder: str, job: str, o: WriterOptions, writers: int) -> None:
    """Stages the files of a job, and writes its manifest, with more tasks than writers.

    Tasks get ranges of writer and order, and write a piece for each of their writers. Where the sizes of a writer's pieces
    rule out a second file, their sums give their places in the first one; else a fold over its records does, of three numbers each.
    """
    spark, path = d.sparkSession, f"{job}/pieces"
    arrow = pa.schema([("w", pa.int32()), ("part", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("bytes_written", pa.int64()), ("piece", pa.string())])
    fold_arrow = pa.schema([("w", pa.int32()), ("part", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("number", pa.int32()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, staging = TaskContext.get().partitionId(), attempt_folder(job, uuid.uuid4().hex)
        now, number, held = None, None, []
        try:
            for b in batches:
                for w, rid, h, block, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if w != number:
                        if now:
                            now.close()
                        now, number = Writer(folder, replace(o, max_file_size=0, name=lambda k, w=w: f"{part}-{w}-{k}"), 0, 1, staging), w
                    name, at, n, _ = now.write(h, block, length)
                    held.append((w, part, at, now.size - at, length, rid, n, f"{now.staging}/{name}"))
                    if len(held) >= ROWS:
                        yield _batch(held, arrow)
                        held = []
            if now:
                now.close()
        except BaseException:
            if now:
                now.abort()
            discard(staging)
            raise
        if held:
            yield _batch(held, arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, number, used, run = None, 0, 0, None
        for b in batches:
            out = []
            for w, part, at, size, length in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if w != who:
                    who, number, used = w, 1, 0
                elif length is not None and used and used + estimate(length, o) > o.max_file_size:
                    number, used = number + 1, 0
                if run and (run[0], run[1], run[4]) == (w, part, number):
                    run[3] = at + size
                else:
                    if run:
                        out.append(run)
                    run = [w, part, at, at + size, number, used]
                used += size
            yield _batch(out, fold_arrow)
        if run:
            yield _batch([run], fold_arrow)

    @F.udf("string")
    def name_of(w, number):
        return format_name(o, (number - 1) * writers + w + 1) + (o.suffix if o.compress else "")

    keys = keys if len(keys) > 1 else [*keys, "record_id"]
    d.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_w", "record_id", "head", "block", "length").mapInArrow(cut, _PIECES).write.parquet(path)
    made = spark.read.schema(_PIECES).parquet(path)
    longest = F.max(F.floor(F.coalesce("length", F.lit(0)) * F.lit(o.ratio if o.compress else 1.0)))
    sums = made.groupBy("w", "part").agg(F.max(F.col("at") + F.col("size")).alias("end"), longest.alias("_longest"), F.first("piece").alias("piece"))
    every, before = W.partitionBy("w"), W.partitionBy("w").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    one = F.lit(True) if o.max_file_size <= 0 else F.sum("end").over(every) + F.max("_longest").over(every) <= o.max_file_size
    sums = sums.select("w", "part", F.lit(0).cast("long").alias("start"), "end", F.lit(1).alias("number"), F.coalesce(F.sum("end").over(before), F.lit(0)).alias("offset"), "piece", one.alias("one"))
    sums.write.parquet(f"{job}/sums")
    sums = spark.read.schema(sums.schema).parquet(f"{job}/sums")
    several = made.select("w", "part", "at", "size", "length").join(sums.where("not one").select("w").distinct(), "w", "left_semi")
    folded = several.repartitionById(writers, "w").sortWithinPartitions("w", "part", "at").mapInArrow(fold, _RUNS).join(sums.select("w", "part", "piece"), ["w", "part"])
    runs = sums.where("one").drop("one").unionByName(folded)
    runs.withColumn("file_name", name_of("w", "number")).write.parquet(f"{job}/runs")
    runs = spark.read.schema(f"{_RUNS}, piece string, file_name string").parquet(f"{job}/runs")
    fs, at = open_folder(job)
    fs.create_dir(f"{at}/files", recursive=False)
    _copy(runs, folder, f"{job}/files", isinstance(fs, pafs.LocalFileSystem))
    staged = F.concat(F.lit(f"{at}/files/"), "file_name")
    none = lambda kind: F.lit(None).cast(kind)
    size = F.max(F.col("offset") + F.col("end") - F.col("start"))
    files = runs.groupBy("file_name").agg(size.alias("file_size")).select(none("string").alias("record_id"), "file_name", none("long").alias("file_offset"), none("long").alias("bytes_written"), "file_size", none("string").alias("warcinfo_id"), staged.alias("staged"))
    placed = made.join(runs.drop("piece"), ["w", "part"]).where("at >= start and at < end")
    placed = placed.select("record_id", "file_name", (F.col("offset") + F.col("at") - F.col("start")).alias("file_offset"), "bytes_written", none("long").alias("file_size"), none("string").alias("warcinfo_id"), staged.alias("staged"))
    placed.unionByName(files).write.parquet(f"{job}/manifest")


#: Bytes that a copy holds.
_COPIED = 4 << 20


def _copy(runs: DataFrame, folder: str, files: str, local: bool) -> None:
    """Copies runs of pieces to their places in files of the folder `files`. A local file is written at several places at once, the same
    bytes at the same place however often; other stores get each file as one stream."""
    runs = runs.select("file_name", "offset", "piece", "start", "end")

    def free(fs: pafs.FileSystem, name: str) -> None:
        if there(fs, f"{open_folder(folder)[1]}/{name}"):
            raise FileExistsError(name)

    def move(src: pa.NativeFile, out: BinaryIO, start: int, end: int) -> None:
        src.seek(start)
        while start < end:
            piece = src.read(min(_COPIED, end - start))
            if not piece:
                raise EOFError("a piece is shorter than it was")
            out.write(piece)
            start += len(piece)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(files)
        for b in batches:
            for name, offset, piece, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                free(fs, name)
                with fs.open_input_file(piece) as src, os.fdopen(os.open(f"{top}/{name}", os.O_WRONLY | os.O_CREAT, 0o666), "wb") as out:
                    out.seek(offset)
                    move(src, out, start, end)
                    out.flush()
                    os.fsync(out.fileno())
            yield b

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(files)
        for b in batches:
            for name, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                free(fs, name)
                temp = f"{top}/{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as out:
                    for p in parts:
                        with fs.open_input_file(p["piece"]) as src:
                            move(src, out, p["start"], p["end"])
                publish(fs, temp, f"{top}/{name}") if not there(fs, f"{top}/{name}") else fs.delete_file(temp)
            yield b

    if local:
        tasks = runs.repartition("piece", "start")
        done = tasks.mapInArrow(places, tasks.schema)
    else:
        tasks = runs.groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("offset", "piece", "start", "end"))).alias("parts"))
        done = tasks.mapInArrow(streams, tasks.schema)
    done.write.format("noop").mode("overwrite").save()


def _where(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def _publish_all(spark: SparkSession, where: str, job: str, after_file: Callable[[str, int, str | None], None] | None = None) -> None:
    """Renames the files of a job that is done, and gives its rows to the manifest. All of it can be done again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, into = open_folder(where)
        for b in batches:
            for staged, name, size, info in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                publish(fs, staged, f"{into}/{name}")
                if after_file:
                    after_file(f"{into}/{name}", size, info)
            sync_folder(fs, into)
            yield b

    made = spark.read.schema(_FILES).parquet(f"{job}/manifest")
    files = made.where("file_offset is null").select("staged", "file_name", "file_size", "warcinfo_id")
    files.mapInArrow(run, files.schema).write.format("noop").mode("overwrite").save()
    sizes = files.select("staged", F.col("file_size").alias("_size"))
    done = made.where("file_offset is not null").join(sizes, "staged").withColumn("file_size", F.col("_size"))
    done.select(*_COLUMNS).write.mode("overwrite").parquet(f"{where}/_manifest/{job.rpartition('/')[2]}")
    discard(job)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record that write_archives has published below the folder."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{_where(on_default(spark, folder))}/_manifest")


def recover(spark: SparkSession, folder: str, *, abandoned: bool = False) -> dict[str, str]:
    """Ends jobs below a folder whose driver was lost: those with a journal are finished. Those without may still
    be at work; they are undone if `abandoned` says that none is. Gives what became of each: finished, undone or open."""
    where, out = _where(on_default(spark, folder)), {}
    for job, journal in jobs(where):
        name = job.rpartition("/")[2]
        if journal and "manifest" in journal:
            _publish_all(spark, where, job)
            out[name] = "finished"
        elif finish_moves(job):
            out[name] = "finished"
        elif abandoned:
            discard(job)
            out[name] = "undone"
        else:
            out[name] = "open"
    return out


def plan_files(records: DataFrame, *, order: tuple[str, ...], max_file_size: int, size: Column, estimated: Column, writers: int = 1, writer: Column | None = None) -> DataFrame:
    """Where each record would go, without writing: writer, file number and offset, by the rule of write_archives.

    The rule is a fold over each writer's records in order, of two numbers a record.
    """
    schema = "writer int, seq long, file_number long, file_offset long"
    w = F.lit(0) if writers == 1 or writer is None else F.pmod(writer, F.lit(writers)).cast("int")
    d = records.select("*", w.alias("writer"), size.cast("long").alias("_size"), estimated.cast("long").alias("_est"))
    d = d.withColumn("seq", F.row_number().over(W.partitionBy("writer").orderBy(*order)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, used = None, 0, 0
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for who, seq, n, est in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if who != at:
                    at, number, used = who, 1, 0
                if max_file_size > 0 and used and used + est > max_file_size:
                    number, used = number + 1, 0
                out.append((who, seq, number, used))
                used += n
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["writer", "seq", "file_number", "file_offset"])

    placed = d.select("writer", "seq", "_size", "_est").repartitionById(writers, "writer").sortWithinPartitions("writer", "seq").mapInArrow(run, schema)
    return d.join(placed, ["writer", "seq"]).drop("_size", "_est")


def compress_records(df: DataFrame, data: str = "bytes", level: int = 6) -> DataFrame:
    """df with column `data` made a gzip member of its own in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(data)
            z = pa.array([None if x is None else gzip.compress(x, level, mtime=0) for x in b.column(i).to_pylist()], pa.binary())
            yield b.set_column(i, pa.field(data, pa.binary()), z)

    return df.mapInArrow(run, df.schema)


def concat_archive(df: DataFrame, data: str, by: Column | str, order: str) -> DataFrame:
    """One binary archive for each key: small archives only, as a row holds it."""
    parts = F.sort_array(F.collect_list(F.struct(order, data)))
    return df.groupBy(by).agg(F.encode(F.array_join(F.transform(parts, lambda p: F.decode(p[data], "ISO-8859-1")), ""), "ISO-8859-1").alias("content"))

