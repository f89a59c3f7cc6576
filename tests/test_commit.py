import gzip
import os
import threading

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tests.test_files import TIME, files, records
from warcspark.sources import commit as C
from warcspark.sources import sink as K
from warcspark.sources.datasource import SeenLog, WarcDataSource, load


def everything(folder):
    return [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs]


def test_the_data_source_aborts_cleanly(spark, tmp_path):
    """Other tasks still write while the driver clears up; twenty times, as it is a race."""
    spark.dataSource.register(WarcDataSource)
    bad = records(spark, 8).select("version", "headers", F.when(F.col("id") == 7, F.raise_error(F.lit("broken row")).cast("binary")).otherwise(F.col("block")).alias("block"))
    for k in range(20):
        with pytest.raises(Exception, match="broken row"):
            bad.write.format("warc").mode("append").option("path", str(tmp_path / f"x{k}")).option("maxFileSize", "1").save()
        assert not everything(tmp_path / f"x{k}")
    with pytest.raises(Exception, match="mode append"):
        records(spark, 1).select("version", "headers", "block").write.format("warc").mode("overwrite").option("path", str(tmp_path / "x")).save()
    for k in range(20):  # and none of them is late
        assert not everything(tmp_path / f"x{k}") and not (tmp_path / f"x{k}" / C.TEMPORARY).exists()


def test_late_tasks_bring_nothing_back(tmp_path):
    job = C.begin(str(tmp_path))
    own = C.attempt_folder(job, "0-a")
    w = K.Writer(str(tmp_path), K.WriterOptions(host="h", time=TIME, max_file_size=1), 0, 1, own)
    w.write(b"WARC/1.1\r\n", b"x", 1)
    stop = threading.Event()

    def busy():
        k = 0
        while not stop.is_set():
            k += 1
            try:
                open(os.path.join(own, str(k)), "w").close()
            except FileNotFoundError:
                return

    t = threading.Thread(target=busy)
    t.start()
    C.discard(job)
    stop.set()
    t.join()
    with pytest.raises((K.JobGone, OSError)):
        for _ in range(3):
            w.write(b"WARC/1.1\r\n", b"x", 1)
    w.abort()
    with pytest.raises(C.JobGone):
        C.attempt_folder(job, "1-b")
    assert not everything(tmp_path) and not os.listdir(tmp_path)


def test_publishing_twice_changes_nothing(tmp_path):
    fs, staged, path = pafs.LocalFileSystem(), str(tmp_path / "s"), str(tmp_path / "p")
    (tmp_path / "s").write_bytes(b"x")
    C.publish(fs, staged, path)
    C.publish(fs, staged, path)
    assert (tmp_path / "p").read_bytes() == b"x" and not (tmp_path / "s").exists()
    (tmp_path / "s").write_bytes(b"y")
    with pytest.raises(FileExistsError):
        C.publish(fs, staged, path)
    with pytest.raises(FileNotFoundError):
        C.publish(fs, str(tmp_path / "nothing"), str(tmp_path / "q"))


def _stop_after(monkeypatch, module, renames):
    """The driver is lost after so many renames."""
    real, left = C.publish, [renames]

    def some(fs, a, b):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        real(fs, a, b)

    monkeypatch.setattr(module, "publish", some)
    return real


@pytest.mark.parametrize("renames", [0, 1, 2, 3])
def test_a_journal_is_finished_by_whoever_finds_it(spark, tmp_path, monkeypatch, renames):
    job = C.begin(str(tmp_path))
    own = C.attempt_folder(job, "0-a")
    moves = []
    for k in range(3):
        open(f"{own}/{k}", "w").write(str(k))
        moves.append((f"{own}/{k}", str(tmp_path / f"done-{k}")))
    assert K.recover(spark, str(tmp_path)) == {job.rpartition("/")[2]: "open"}
    C.record(job, {"moves": moves})
    monkeypatch.setattr(C, "THREADS", 1)
    real = _stop_after(monkeypatch, C, renames)
    if renames < 3:
        with pytest.raises(KeyboardInterrupt):
            C.finish_moves(job)
        assert len(files(tmp_path)) == renames
    monkeypatch.setattr(C, "publish", real)
    assert K.recover(spark, str(tmp_path)) == {job.rpartition("/")[2]: "finished"}
    assert files(tmp_path) == ["done-0", "done-1", "done-2"] == sorted(os.listdir(tmp_path)) and K.recover(spark, str(tmp_path)) == {}


@pytest.mark.parametrize("part", [False, True])
def test_a_driver_lost_between_two_renames(spark, tmp_path, monkeypatch, part):
    """write_archives ends after its journal, before or within the renames: recovery gives each record once."""
    real = K._publish_all

    def lost(spark, where, job, after_file=None):
        if part:  # some files are in place, and the manifest isn't
            made = spark.read.parquet(f"{job}/manifest").where("file_offset is null").limit(2).collect()
            for r in made:
                os.rename(r.staged, str(tmp_path / "a" / r.file_name))
        raise KeyboardInterrupt

    o = K.WriterOptions(host="h", time=TIME, max_file_size=1)
    monkeypatch.setattr(K, "_publish_all", lost)
    with pytest.raises(KeyboardInterrupt):
        K.write_archives(records(spark, 6), str(tmp_path / "a"), o, writers=2)
    monkeypatch.setattr(K, "_publish_all", real)
    assert len(files(tmp_path / "a")) == (2 if part else 0)
    K.write_archives(records(spark, 3), str(tmp_path / "a"), K.WriterOptions(host="other", time=TIME), writers=1)
    assert list(K.recover(spark, str(tmp_path / "a")).values()) == ["finished"] and K.recover(spark, str(tmp_path / "a")) == {}
    m = K.manifest(spark, str(tmp_path / "a"))
    assert m.count() == 9 == load(spark, str(tmp_path / "a")).count() and m.where("file_name like '%-h.warc.gz'").select("record_id").distinct().count() == 6
    assert all(r.file_size == os.path.getsize(tmp_path / "a" / r.file_name) for r in m.collect())


def test_a_driver_lost_before_its_journal(spark, tmp_path):
    job = C.begin(str(tmp_path / "b"))
    open(C.attempt_folder(job, "0-a") + "/0", "w").close()
    K.write_archives(records(spark, 3), str(tmp_path / "b"), K.WriterOptions(host="h", time=TIME), writers=1)
    assert list(K.recover(spark, str(tmp_path / "b")).values()) == ["open"]
    assert list(K.recover(spark, str(tmp_path / "b"), abandoned=True).values()) == ["undone"]
    assert load(spark, str(tmp_path / "b")).count() == 3 and not (tmp_path / "b" / C.TEMPORARY).exists()


def test_stream_to_archives_and_back(spark, tmp_path):
    """Batches come once, also where the query ends between its sink's commit and its own."""
    spark.dataSource.register(WarcDataSource)
    src, out, mark = tmp_path / "src", tmp_path / "out", tmp_path / "mark"
    rows = records(spark, 40, 50).select("version", "headers", "block")
    for k in range(4):
        rows.where(f"abs(hash(headers)) % 4 = {k}").coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        q = stream.writeStream.format("warc").option("path", str(out)).option("maxFileSize", "300").option("prefix", "s-").option("checkpointLocation", str(mark)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    run()
    names = files(out)
    ids = lambda: sorted(r.record_id for r in load(spark, str(out)).collect())
    assert len(names) >= 8 and len(set(ids())) == 40 == len(ids())
    run()  # nothing new
    os.remove(mark / "commits" / "3")
    if (mark / "commits" / ".3.crc").exists():
        os.remove(mark / "commits" / ".3.crc")
    run()  # batch 3 comes again
    assert files(out) == names and len(ids()) == 40
    rows.limit(1).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert len(files(out)) == len(names) + 1 and len(ids()) == 41
    numbers = sorted(int(n.split("-")[2]) for n in files(out))
    assert numbers == list(range(1, len(names) + 2))


def test_a_log_of_seen_files(tmp_path):
    log = SeenLog(str(tmp_path / "l"))
    names = [f"f{k}" for k in range(1000)]
    for k in range(0, 1000, 7):
        assert log.add(names[: k + 7], 5) == min(log.last, 1000)
    while log.add(names, 300) < 1000:
        pass
    assert log.between(0, 1000) and sorted(log.between(0, 1000)) == sorted(names) and log.between(3, 3) == []
    before = log.between(10, 950)
    many = len(os.listdir(tmp_path / "l"))
    log.compact(900)
    assert len(os.listdir(tmp_path / "l")) < many / 2
    again = SeenLog(str(tmp_path / "l"))
    assert again.last == 1000 and again.between(10, 950) == before and again.add(names, 0) == 1000 and again.add(["late"], 0) == 1001
    # a compaction that stopped before it deleted the old segments
    C.write_once(pafs.LocalFileSystem(), str(tmp_path / "l" / f"{0:020d}-{1001:020d}.json"), {"names": again.between(0, 1001)})
    assert SeenLog(str(tmp_path / "l")).between(0, 1001) == again.between(0, 1001)


def test_streams_with_a_log_and_a_limit(spark, tmp_path):
    from tests.test_framing import record

    spark.dataSource.register(WarcDataSource)
    folder = tmp_path / "s"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("warc").option("seenLog", str(tmp_path / "log")).option("maxFilesPerTrigger", "3").load(str(folder)).select("file_path")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
        return sorted(os.path.basename(r.file_path) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k in (5, 6, 7, 8):
        (folder / f"{k}.warc.gz").write_bytes(gzip.compress(record()))
    assert len(run()) == 3 and len(run()) == 4
    (folder / "1.warc.gz").write_bytes(gzip.compress(record()))
    assert run() == run() == [f"{k}.warc.gz" for k in (1, 5, 6, 7, 8)]
    assert max(os.path.getsize(tmp_path / "c" / "offsets" / f) for f in os.listdir(tmp_path / "c" / "offsets")) < 2000
    with pytest.raises(Exception, match="seenLog"):
        spark.readStream.format("warc").option("maxFilesPerTrigger", "3").load(str(folder)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).start().processAllAvailable()
