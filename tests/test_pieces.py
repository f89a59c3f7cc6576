"""Writers that are fewer than the tasks: files in pieces, ranges in few tasks, captures read from sorted places."""

import gzip
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from warcspark.operators import analytics as A
from warcspark.operators.build import build_records
from warcspark.sources import sink as K
from warcspark.sources import splits as S
from warcspark.sources.datasource import Range, grouped, load

TIME = datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)


def records(spark, n):
    d = spark.range(n).select("id", F.concat(F.repeat(F.lit("x"), (F.col("id") * 37 % 400).cast("int")), F.col("id").cast("string")).alias("b"), (F.col("id") % 5).alias("g"))
    h = {"WARC-Record-ID": F.concat(F.lit("<urn:r:"), F.col("id").cast("string"), F.lit(">")), "WARC-Date": "2024-01-01T00:00:00Z"}
    return build_records(d.repartition(3), "resource", "b", h, keep=("id", "g"))



@pytest.mark.parametrize("limit, compress, writers, local", [(0, True, 2, True), (3000, True, 2, True), (9000, False, 1, False)])
def test_pieces_make_the_files_of_one_writer(spark, tmp_path, monkeypatch, limit, compress, writers, local):
    """The same files, byte by byte, as from one task for each writer; no task gets all of a writer's records."""
    parts, real, copied = [], K._in_pieces, K._copy

    def seen(d, keys, folder, job, o, w):
        real(d, keys, folder, job, o, w)
        parts.extend(r.n for r in d.sparkSession.read.parquet(f"{job}/pieces").groupBy("w", "part").agg(F.count(F.lit(1)).alias("n")).collect())

    monkeypatch.setattr(K, "_in_pieces", seen)
    monkeypatch.setattr(K, "_copy", lambda runs, folder, files, is_local: copied(runs, folder, files, is_local and local))
    o = K.WriterOptions(max_file_size=limit, ratio=1.0, compress=compress, host="h", time=TIME)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = K.write_archives(records(spark, 120), str(tmp_path / "p"), o, writers=writers, order=("id",)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(parts) > writers and max(parts) < 120 / writers * 0.8
    # a callback makes each writer a task
    one = K.write_archives(records(spark, 120), str(tmp_path / "w"), K.replace(o, before_file=lambda p: None), writers=writers, order=("id",)).collect()
    assert sorted(m) == sorted(one) and len(m) == 120
    names = {r.file_name for r in m}
    assert (len(names) > writers) == (limit > 0)
    for n in names:
        assert (tmp_path / "p" / n).read_bytes() == (tmp_path / "w" / n).read_bytes()
    r = m[7]
    data = (tmp_path / "p" / r.file_name).read_bytes()[r.file_offset :]
    assert f"<{r.record_id}>".encode() in (gzip.decompress(data) if compress else data)[: r.bytes_written]
    assert not (tmp_path / "p" / "_temporary").exists() and load(spark, str(tmp_path / "p")).count() == 120


def test_pieces_of_nothing_and_of_taken_names(spark, tmp_path):
    o = K.WriterOptions(max_file_size=0, host="h", time=TIME)
    assert K.write_archives(records(spark, 0), str(tmp_path / "e"), o, writers=1).count() == 0
    K.write_archives(records(spark, 20), str(tmp_path / "e"), o, writers=1)
    before = {n: (tmp_path / "e" / n).read_bytes() for n in os.listdir(tmp_path / "e") if n.endswith(".gz")}
    with pytest.raises(Exception, match="FileExists"):
        K.write_archives(records(spark, 20), str(tmp_path / "e"), o, writers=1)
    assert before == {n: (tmp_path / "e" / n).read_bytes() for n in os.listdir(tmp_path / "e") if n.endswith(".gz")} and len(before) == 1


def test_small_ranges_share_tasks(spark, tmp_path):
    """As many ranges as the bytes ask for, but tasks by bytes and cores, and each record once."""
    K.write_archives(records(spark, 400), str(tmp_path / "s"), K.WriterOptions(max_file_size=0, compress=False, host="h", time=TIME), writers=1, order=("id",))
    A.index(load(spark, str(tmp_path / "s"))).write.parquet(str(tmp_path / "index"))
    for more in ({"split_bytes": 1000}, {"index": str(tmp_path / "index"), "rangeBytes": "1000"}):
        got = load(spark, str(tmp_path / "s"), **more)
        assert 4 < got.rdd.getNumPartitions() <= 2 * 4 * spark.sparkContext.defaultParallelism
        assert got.count() == 400 == got.select("record_offset").distinct().count()
    cuts = [Range("f", k, k + 10) for k in range(0, 1000, 10)] + [Range("f", 1000, None)]
    groups = grouped(cuts, 8)
    assert len(groups) <= 10 and [r for g in groups for r in g.ranges] == cuts and len(grouped(cuts, 0)) == 101


def test_places_in_order_read_a_file_once(tmp_path, monkeypatch):
    """Records that stand side by side come from the same pieces; those far apart don't cost a whole piece each."""
    f, loads, real = tmp_path / "f", [], S.Window._load
    data = bytes(range(256)) * (3 << 12)
    f.write_bytes(data)
    monkeypatch.setattr(S.Window, "_load", lambda self, place, n: (loads.append(n), real(self, place, n)))
    w = S.Window(str(f))

    def read(at, n):
        w.seek(at)
        out = b""
        while len(out) < n and (piece := w.read(n - len(out))):
            out += piece
        return out

    for at in range(0, len(data), 1000):
        assert read(at, 1000) == data[at : at + 1000]
    assert sum(loads) < 2 * len(data) and len(loads) < 20
    loads.clear()
    for at in (5, 2 << 20, 100, len(data) - 3):
        assert read(at, 70_000) == data[at : at + 70_000]
    assert sum(loads) <= 4 * 2 * S.NEAR
    assert read(len(data) + 5, 3) == b"" and read(7, 2 << 20) == data[7 : 7 + (2 << 20)]
    w.close()
