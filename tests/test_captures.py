import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tests.test_framing import record
from warcspark.operators import analytics as A
from warcspark.operators import captures as C
from warcspark.operators.build import build_records
from warcspark.sources.datasource import load

START = datetime(2024, 1, 1, tzinfo=UTC)


def test_keys(spark):
    rows = [("http://WWW.Example.org:80/a?b#c", "org,example,www)/a?b"), ("https://u@x.y", "y,x)/"), ("no url", "/"), ("http:///p", "/p"), ("ftp://a/#x", "a)/")]
    got = spark.createDataFrame(rows, "u string, k string").select(C.url_key("u").alias("g"), "k").collect()
    assert [r.g for r in got] == [r.k for r in got]


def test_domains_are_ranges(spark):
    hosts = ["example.org", "www.example.org", "example.com", "myexample.org", "example.org.net", "a.b.example.org", "example-x.org"]
    d = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", C.url_key(F.concat(F.lit("http://"), "h", F.lit("/p"))).alias("key"))
    assert {r.h for r in C.under(d, "Example.org").collect()} == {"example.org", "www.example.org", "a.b.example.org"}


def test_nearest_on_either_side(spark):
    rng = random.Random(3)
    have = [(rng.choice("ab"), START + timedelta(hours=rng.randint(0, 300)), f"f{k}", k) for k in range(80)] + [("c", START, "f", 999)]
    asks = [(k, rng.choice("abcd"), START + timedelta(hours=rng.randint(-20, 320), minutes=rng.choice([0, 30]))) for k in range(300)]
    index = spark.createDataFrame(have, "key string, captured timestamp, file_path string, record_offset long")
    for c in C.INDEX[4:]:
        index = index.withColumn(c, F.lit(1))
    got = {r.id: r.capture for r in C.nearest(spark.createDataFrame(asks, "id int, key string, time timestamp"), index).collect()}
    assert len(got) == 300
    for i, k, t in asks:
        mine = [h for h in have if h[0] == k]
        if not mine:
            assert got[i] is None
            continue
        best = min(abs(h[1] - t) for h in mine)
        early = min(h[1] for h in mine if abs(h[1] - t) == best)
        assert got[i].captured.astimezone(UTC) == early and any(h[1] == early and h[2] == got[i].file_path for h in mine)


def test_index_files_are_sorted_and_places_are_read(spark, tmp_path):
    d = spark.range(60).select("id", F.concat(F.lit("body "), "id").alias("b"))
    made = build_records(d, "resource", "b", {"WARC-Record-ID": F.concat(F.lit("<urn:r:"), F.col("id").cast("string"), F.lit(">")), "WARC-Date": F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "WARC-Target-URI": F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/")), "Content-Type": "text/plain"})
    from warcspark.sources import sink as K

    K.write_archives(made, str(tmp_path / "a"), K.WriterOptions(host="h"), writers=3)
    (tmp_path / "a" / "odd.warc").write_bytes(record(b"no date"))
    index = C.write_index(load(spark, str(tmp_path / "a")), str(tmp_path / "i"), partitions=4)
    assert 60 <= index.count() <= 61
    ends = sorted((r.a, r.z) for r in index.groupBy(F.input_file_name()).agg(F.min(F.struct("key", "captured")).alias("a"), F.max(F.struct("key", "captured")).alias("z")).collect())
    assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False)) and len(ends) > 1
    one = C.under(index, "h3.org")
    got = C.read_at(spark, one).collect()
    assert sorted(int(bytes(r.block)[5:]) for r in got) == [k for k in range(60) if k % 7 == 3] and not any(r.error or r.validation for r in got)
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key,org,h3" in plan


def test_segments(spark):
    rows = [("a", 1, 5, None), ("a", 2, 5, None), ("a", 3, 5, 15), ("b", 1, 5, None), ("b", 3, 5, 15), ("b", 3, 5, 15), ("b", 7, 1, None), ("c", 2, 4, 9), ("d", 1, 3, None), ("d", 2, 3, 7), ("e", 1, 3, None), ("e", 2, 3, None), ("f", None, 3, None), ("g", 1, 2, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o string, n int, len int, total long").withColumn("b", F.expr("repeat(o, len)"))
    first = (F.col("n") == 1) | (F.col("o") == "f")
    h = {"WARC-Record-ID": F.when(first, F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit("<x:"), "i", F.lit(">"))), "WARC-Segment-Origin-ID": F.when(~first | (F.col("o") == "f"), F.concat(F.lit("<"), "o", F.lit(">"))), "WARC-Segment-Number": F.col("n").cast("string"), "WARC-Segment-Total-Length": F.col("total").cast("string")}
    r = build_records(d, F.when(F.col("n") == 1, F.lit("resource")).otherwise(F.lit("continuation")), "b", h).repartition(3)
    got = sorted((x.origin_id, x.kind, x.first, x.last) for x in A.segment_findings(r).collect())
    assert got == [("b", "missing", 2, 2), ("b", "missing", 4, 6), ("b", "repeated", 3, 3), ("c", "missing", 1, 1), ("c", "unnumbered_origin", 2, 2), ("d", "total_length", 7, 6), ("e", "no_total", None, 6), ("f", "unnumbered_origin", None, None)]
    import hashlib

    digests = {x.origin_id: (x.segments, x.size, x.digest) for x in A.segment_digests(r).collect()}
    assert digests["a"] == (3, 15, hashlib.sha1(b"a" * 15).hexdigest()) and digests["b"][:2] == (4, 16) and len(digests) == 6
