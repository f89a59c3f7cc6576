import gzip
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tests.test_framing import record
from warcspark.functions import fields as H
from warcspark.operators import analytics as A
from warcspark.operators import parse as P
from warcspark.operators.build import build_records
from warcspark.options import WarcOptions
from warcspark.sources import sink as K
from warcspark.sources.datasource import WarcDataSource, list_files, load
from warcspark.streaming import first_captures, read_archive_stream, sessions, windowed_counts

TIME = datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)
INFO = (("software", "a tool"), ("format", "WARC"))


def records(spark, n=3, size=200):
    df = spark.range(n).select("id", F.repeat(F.lit("x"), size).alias("body"), (F.col("id") % 2).alias("g"))
    return build_records(df, "resource", "body", {"WARC-Record-ID": F.concat(F.lit("<urn:r:"), F.col("id").cast("string"), F.lit(">")), "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "text/plain"}, keep=("id", "g"))


def files(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith(("_", ".")))


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("info", [None, INFO])
def test_manifest_is_where_records_are(spark, tmp_path, compress, info):
    made = []
    o = K.WriterOptions(compress=compress, warcinfo=info, prefix="foo-", host="example", time=TIME)
    m = K.write_archives(records(spark, 5), str(tmp_path / "a"), o, writers=1, order=("id",)).orderBy("file_offset").collect()
    name = "foo-20010912053020-0001-example.warc" + (".gz" if compress else "")
    assert files(tmp_path / "a") == [name] and {r.file_name for r in m} == {name} and not made
    data = (tmp_path / "a" / name).read_bytes()
    assert {r.file_size for r in m} == {len(data)}
    for r in m:
        part = data[r.file_offset :]
        text = gzip.decompress(part) if compress else part
        assert text.startswith(b"WARC/1.1\r\n") and f"<{r.record_id}>".encode() in text[: r.bytes_written]
    back = load(spark, str(tmp_path / "a")).orderBy("record_offset").collect()
    assert [r.record_type for r in back] == (["warcinfo"] if info else []) + ["resource"] * 5
    assert not any(r.validation or r.error for r in back)
    if info:
        assert [tuple(f) for f in back[0].warc_fields] == [("Software", "a tool"), ("Format", "WARC")]
        assert {x.value for r in back[1:] for x in r.headers if x.name == "WARC-Warcinfo-ID"} == {f"<{back[0].record_id}>"}


def test_rolling(spark, tmp_path):
    for limit, ratio, n in ((0, 1.0, 1), (800, 1.0, 3), (10**6, 1.0, 1), (1, 1.0, 6)):
        folder = tmp_path / f"r{limit}"
        m = K.write_archives(records(spark, 6), str(folder), K.WriterOptions(max_file_size=limit, ratio=ratio, compress=False, host="h", time=TIME), writers=1, order=("id",)).collect()
        used, want, at = 0, 1, []
        for r in sorted(m, key=lambda r: r.record_id):
            if limit > 0 and used and used + 200 > limit:
                want, used = want + 1, 0
            at.append((want, used))
            used += r.bytes_written
        assert len(files(folder)) == want and (n == want or limit == 800)
        assert [r.file_offset for r in sorted(m, key=lambda r: r.record_id)] == [o for _, o in at]


def test_writers_groups_and_failures(spark, tmp_path):
    o = K.WriterOptions(host="h", time=TIME)
    m = K.write_archives(records(spark, 40), str(tmp_path / "w"), o, writers=3, group="g").collect()
    by = {}
    for r in m:
        by.setdefault(int(r.record_id.split(":")[-1]) % 2, set()).add(r.file_name)
    assert len(m) == 40 and all(len(v) == 1 for v in by.values())
    with pytest.raises(Exception, match="FileExists"):
        K.write_archives(records(spark, 2), str(tmp_path / "w"), o, writers=3, group="g")
    assert not [f for f in os.listdir(tmp_path / "w") if f.endswith(".open")]
    with pytest.raises(ValueError):
        K.WriterOptions(level=11)
    assert K.WriterOptions(ratio=7).ratio == 0.5


def test_hooks(tmp_path):
    seen = []
    w = K.Writer(str(tmp_path / "h"), K.WriterOptions(host="h", time=TIME, warcinfo=INFO, before_file=lambda p: seen.append(("before", os.path.basename(p))), after_file=lambda p, n, i: seen.append((os.path.basename(p), n, i is not None))), 0, 1)
    name, at, n, info = w.write(b"WARC/1.1\r\nA: b\r\n", b"x", 1)
    assert os.listdir(tmp_path / "h") == [name + ".open"] and at > 0 and info
    w.close()
    assert seen == [("before", name), (name, os.path.getsize(tmp_path / "h" / name), True)]
    w.write(b"WARC/1.1\r\n", b"", 0)
    w.abort()
    assert files(tmp_path / "h") == [name]


def test_concurrent_to(spark):
    r = K.add_concurrent_to(records(spark, 5), "g").select("id", H.get_all("headers", "WARC-Concurrent-To").alias("c")).collect()
    assert {x.id: x.c for x in r} == {i: [f"<urn:r:{j}>" for j in range(5) if j != i and j % 2 == i % 2] for i in range(5)}


def test_plan_files_agrees_with_writing(spark, tmp_path):
    recs = records(spark, 9)
    m = K.write_archives(recs, str(tmp_path / "p"), K.WriterOptions(max_file_size=900, compress=False, host="h", time=TIME), writers=1, order=("id",)).withColumn("id", F.element_at(F.split("record_id", ":"), -1).cast("long"))
    plan = K.plan_files(recs.join(m.select("id", "bytes_written"), "id"), order=("id",), max_file_size=900, size=F.col("bytes_written"), estimated=F.col("content_length"))
    got = plan.join(m.select(F.col("id").alias("i"), "file_offset", "file_name").withColumnRenamed("file_offset", "o"), F.col("id") == F.col("i"))
    assert got.where("file_offset <> o or file_number <> cast(substr(file_name, 16, 4) as int)").count() == 0 and got.count() == 9


def test_data_source(spark, tmp_path):
    spark.dataSource.register(WarcDataSource)
    folder = tmp_path / "d"
    records(spark, 30).select("version", "headers", "block").repartition(2).write.format("warc").mode("append").option("path", str(folder)).option("prefix", "p-").option("maxFileSize", "2000").save()
    assert len(files(folder)) >= 2
    assert load(spark, str(folder)).count() == 30 == load(spark, f"{folder}/p-*.gz").count()
    assert spark.read.format("warc").option("readBlock", "false").load(str(folder)).where("block is null").count() == 30
    assert load(spark, str(folder), types="response").count() == 0
    (folder / "bad.warc").write_bytes(b"GARBAGE" + record())
    assert load(spark, str(folder), WarcOptions()).where("error is not null").count() == 0
    with pytest.raises(Exception, match="no record starts here"):
        spark.read.format("warc").option("preset", "strict").load(f"{folder}/bad.warc").count()
    assert load(spark, f"{folder}/bad.warc", offset="7").select("skipped_bytes", "record_offset").first() == (0, 7)
    big = tmp_path / "big.warc"
    big.write_bytes(record(b"y" * 1000) * 50)
    A.index(load(spark, str(big))).write.parquet(str(tmp_path / "index"))
    cut = load(spark, str(big), index=str(tmp_path / "index"), rangeBytes="10000")
    assert cut.rdd.getNumPartitions() > 3 and cut.count() == 50 == cut.select("record_offset").distinct().count()
    with pytest.raises(FileNotFoundError):
        list_files(str(tmp_path / "nothing"))
    assert P.read_files(spark, str(big)).count() == 50


def test_streams(spark, tmp_path):
    spark.dataSource.register(WarcDataSource)
    folder = tmp_path / "s"
    folder.mkdir()
    (folder / "a.warc").write_bytes(record() * 3)
    (folder / "b.warc.gz").write_bytes(gzip.compress(record()))
    for name, stream in (("files", read_archive_stream(spark, str(folder))), ("source", spark.readStream.format("warc").load(str(folder)))):
        q = stream.select("record_offset").writeStream.format("memory").queryName(f"got_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(f"got_{name}").count() == 4


def test_stream_reads_late_files_with_smaller_names(spark, tmp_path):
    spark.dataSource.register(WarcDataSource)
    folder = tmp_path / "s"
    (folder / "0").mkdir(parents=True)

    def run():
        q = spark.readStream.format("warc").load(str(folder)).select("file_path", "record_offset").writeStream.format("parquet")
        q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(os.path.relpath(r.file_path, folder) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "b.warc").write_bytes(record() * 2)
    assert run() == ["b.warc"] * 2
    (folder / "a.warc").write_bytes(record())
    (folder / "0" / "z.warc").write_bytes(record())
    os.utime(folder / "a.warc", (1, 1))
    assert run() == ["0/z.warc", "a.warc", "b.warc", "b.warc"]
    (folder / "b.warc").unlink()
    (folder / "c.warc").write_bytes(record())
    assert run() == run() == ["0/z.warc", "a.warc", "b.warc", "b.warc", "c.warc"]


def test_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (2, "2024-01-01 00:01:10"), (1, "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "k int, t string").select("k", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "e"))

    def run(name, f):
        s = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "e"))
        q = f(s).writeStream.format("memory").outputMode("append" if name == "first" else "complete").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert {(r.k, r.n) for r in run("win", lambda s: windowed_counts(s, "t", "1 minute", ["k"])).collect()} == {(1, 2), (2, 1), (1, 1)}
    assert sorted((r.k, r.n) for r in run("ses", lambda s: sessions(s, "t", "1 minute", ["k"])).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert run("first", lambda s: first_captures(s, "t", ["k"])).count() == 2


def test_as_of_and_segments(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", 3, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("c", 1, "z")], "k string, t int, v string")
    got = A.as_of(left, right, by="k", left_time="t", right_time="t", value="v", out="v").collect()
    assert {r.id: r.v for r in got} == {1: "y", 2: None, 3: None, 4: "x"}
    import random

    rng = random.Random(2)
    many = [(rng.choice("ab"), rng.randint(0, 60), i) for i in range(200)]
    some = [(rng.choice("abc"), rng.randint(0, 60), rng.choice(["x", "y", "z", None])) for _ in range(60)]
    want = {i: max(((u, v) for m, u, v in some if m == k and u <= t and v is not None), default=(0, None))[1] for k, t, i in many}
    l, r = spark.createDataFrame(many, "k string, t int, id int"), spark.createDataFrame(some, "k string, t int, v string")
    for bucket in (None, lambda t: F.floor(t / 10), lambda t: t):
        assert {x.id: x.v for x in A.as_of(l, r, by="k", left_time="t", right_time="t", value="v", out="v", bucket=bucket).collect()} == want
    assert A.of_types(records(spark), "response", "resource").count() == 3 and A.of_types(records(spark), "revisit").count() == 0


def test_table_function(spark):
    from warcspark.sources.udtf import register

    register(spark)
    spark.createDataFrame([(bytearray(b"XX" + record() * 2),), (None,)], "content binary").createOrReplaceTempView("archives")
    got = spark.sql("select p.record_offset, p.skipped_bytes, p.headers[0].value as kind, p.findings from archives, lateral parse_records(content) p order by 1").collect()
    assert [(r.record_offset, r.skipped_bytes, r.kind, len(r.findings)) for r in got] == [(2, 2, "resource", 1), (2 + len(record()), 0, "resource", 0)]


def test_a_failed_job_publishes_nothing(spark, tmp_path):
    """The second file of a writer can't be opened: neither it nor the first one is there, and no manifest."""
    seen = []

    def refuse(path):
        if "-0002-" in path:
            raise RuntimeError("no room")

    o = K.WriterOptions(max_file_size=1, compress=False, host="h", time=TIME, before_file=refuse)
    with pytest.raises(Exception, match="no room"):
        K.write_archives(records(spark, 4), str(tmp_path / "f"), o, writers=1)
    assert files(tmp_path / "f") == seen and not [f for _, _, fs in os.walk(tmp_path / "f") for f in fs]
    m = K.write_archives(records(spark, 4), str(tmp_path / "f"), K.WriterOptions(max_file_size=1, compress=False, host="h", time=TIME), writers=1)
    assert m.count() == 4 == len(files(tmp_path / "f"))


def test_attempts_that_fail_leave_each_record_once(tmp_path):
    """A task that fails after it has rolled a file, and is run again by Spark, in a process of its own."""
    import subprocess
    import sys

    code = f"""
import os, time
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from warcspark.operators.build import build_records
from warcspark.sources import sink as K
from warcspark.sources.datasource import WarcDataSource, load
def once(path):
    mark = "{tmp_path}/failed"
    if "-0003-" in path and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost")
df = build_records(spark.range(6).select("id", F.lit("x").alias("b")), "resource", "b", {{"WARC-Record-ID": F.concat(F.lit("<urn:r:"), F.col("id").cast("string"), F.lit(">")), "WARC-Date": "2024-01-01T00:00:00Z"}}, keep=("id",))
m = K.write_archives(df, "{tmp_path}/out", K.WriterOptions(max_file_size=1, host=None, before_file=once), writers=1, order=("id",))
print(os.path.exists("{tmp_path}/failed"), m.count(), m.select("file_name").distinct().count(), load(spark, "{tmp_path}/out").select("record_id").distinct().count(), load(spark, "{tmp_path}/out").count())
spark.dataSource.register(WarcDataSource)
def flaky(batches):
    from pyspark import TaskContext
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
rows = df.select("version", "headers", "block")
rows.repartition(2).mapInArrow(flaky, rows.schema).write.format("warc").mode("append").option("path", "{tmp_path}/src").option("maxFileSize", "1").save()
names = sorted(os.listdir("{tmp_path}/src"))
print(len(names), load(spark, "{tmp_path}/src").count(), sorted(n.split("-")[1] for n in names) == ["%04d" % k for k in range(1, 7)])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split("\n")[:2] == ["True 6 6 6 6", "6 6 True"], out.stdout


def test_records_are_synced_one_by_one(tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(os, "fsync", lambda n: seen.append(n))
    w = K.Writer(str(tmp_path / "y"), K.WriterOptions(host="h", time=TIME, flush=True), 0, 1)
    for _ in range(3):
        w.write(b"WARC/1.1\r\n", b"x", 1)
    assert len(seen) == 3
    w.close()


def test_interval_join_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    left = [(i, rng.choice([rng.uniform(-50, 50), float(rng.randint(-50, 50))]), rng.choice("ab")) for i in range(200)] + [(999, None, "a")]
    right = [(j, s := rng.choice([rng.uniform(-50, 50), float(rng.randint(-50, 50))]), s + rng.choice([0.0, 1.0, 10.0, 33.3, -2.0]), rng.choice("ab")) for j in range(60)] + [(99, None, 3.0, "a")]
    l, r = spark.createDataFrame(left, "i long, t double, k string"), spark.createDataFrame(right, "j long, s double, e double, k string")
    for width in (1.0, 7.5, 1000.0):
        got = sorted((x.i, x.j) for x in A.interval_join(l, r, at="t", start="s", end="e", bin=width, on=("k",)).collect())
        assert got == sorted((i, j) for i, t, k in left for j, s, e, m in right if k == m and None not in (t, s) and s <= t < e)
    with pytest.raises(ValueError):
        A.interval_join(l, r, at="t", start="s", end="e", bin=1.0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from warcspark import storage

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Context.master = "local[4]"
    assert storage.shared_dir(Session()).startswith("file:///tmp/")
    assert storage.on_default(spark, "/a/b") == "/a/b" and storage.on_default(spark, "s3://x/y") == "s3://x/y"
