"""Values of a megabyte: every pattern of the package must go through them in line with their length."""

import time

import pytest
from pyspark.sql import functions as F

from warcspark.functions import blocks as B
from warcspark.functions import digest as D
from warcspark.functions import fields as H
from warcspark.operators import analytics as A
from warcspark.operators import parse as P
from warcspark.operators import validate as V
from warcspark.options import WarcOptions

N = 1 << 20
#: Each runs of one piece, with what comes before and after.
PIECES = ["a", "0", "9", "_1", " ", "\t", "\r", "=", "<", ">", ".", "1.", "%41", "%", "a@", "/", "\\", "[", "::", "1:", "=?", "=?utf-8?q?", "=?utf-8?b?", "é", "x y", ": ", "\n ", "\n", "x\n", "-", "Z", ",1"]
EDGES = [("", ""), ("http://", ""), ("http://", "!"), ("http://a/", "x"), ("x", "y"), ("<", ">"), ("0x", ""), ("0x", "g"), ("x:", ":"), ("HTTP/1.1 200 ", "x"), ("sha1:", "!"), ("2024-01-01T00:00:00.", "Z"), ("file:", ""), ("foo:", "|"), ("http://[", "]"), ("=?utf-8?q?a?=", "=?utf-8?q?b?=")]


@pytest.fixture(scope="module")
def values(spark, tmp_path_factory):
    rows = [(f"{a!r}{p!r}{z!r}", a, p, z, n) for n, edges in ((N >> 4, EDGES), (N, EDGES[2:5:2])) for p in PIECES for a, z in edges]
    d = spark.createDataFrame(rows, "name string, a string, p string, z string, n int").repartition(16)
    path = str(tmp_path_factory.mktemp("long") / "values")
    d.select("name", F.concat("a", F.expr(f"repeat(p, cast(n / length(p) as int))"), "z").alias("v")).write.parquet(path)
    return spark.read.parquet(path)


CHECKS = {
    "uri": lambda v: V.is_uri(v),
    "id": lambda v: V.is_id(v),
    "ip": lambda v: V.is_ip(v),
    "int": lambda v: V.is_int(v),
    "long": lambda v: V.is_long(v),
    "time": lambda v: V.is_time(v),
    "bare": lambda v: F.length(H.bare_id(v)),
    "words": lambda v: F.length(H.decode_words(v)),
    "lenient": lambda v: F.size(H.parse_lenient(v, words=True)),
    "lines": lambda v: F.size(V.line_findings(F.substring(v, 1, 1 << 16))),
    "http": lambda v: B.http_struct(F.encode(v, "UTF-8"), B.http_head_length(F.encode(v, "UTF-8")), F.lit(True))["status_code"],
    "digest": lambda v: D.parse_field(v)["algorithm"],
    "same": lambda v: D.same_value(v, v),
    "host": lambda v: F.length(A.host(v)),
    "name": lambda v: F.length(H.normalize_name(v)),
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_patterns_on_a_megabyte(spark, values, name):
    began = time.time()
    rows = values.select(CHECKS[name](F.col("v")).cast("string").alias("x")).where("x is not null or x is null").agg(F.count(F.lit(1)), F.max("x")).first()
    assert rows[0] == len(PIECES) * (len(EDGES) + 2)
    assert time.time() - began < 120, "some value takes more than linear time"


def test_what_the_patterns_say_of_long_values(spark):
    rows = [("http://" + "a" * 10_000 + ".org/", True), ("http://" + "a" * 10_000 + "|/", False), ("http://x/" + "p" * N, True), ("http://" + "%41" * 5000, True), ("http://" + "%00" * 5000, False)]
    got = spark.createDataFrame(rows, "v string, ok boolean").select(V.is_uri(F.col("v")).alias("got"), "ok").collect()
    assert all(r.got == r.ok for r in got)
    numbers = [("0" * 8000 + "7", True), ("9" * 8000, False), ("0x" + "_0" * 8000 + "1", True), ("0x" + "f" * 8000, False), ("1_" * 8000, False), ("0b" + "01" * 10, True), ("12_3", True), ("1__2", False), ("0o17", True), ("08", False)]
    assert all(r.got == r.ok for r in spark.createDataFrame(numbers, "v string, ok boolean").select(V.is_long(F.col("v")).alias("got"), "ok").collect())
    heads = [("A:  b \t c  \n  d \r\nE:\x85f\x85g \nH :i", [("A", "b \t c d"), ("E", "\x85f\x85g"), ("H", "i")])]
    got = spark.createDataFrame(heads, "t string, w array<struct<n:string,v:string>>").select(H.parse_lenient("t").alias("g"), "w").first()
    assert [tuple(x) for x in got.g] == [tuple(x) for x in got.w]


def _record(**more):
    head = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:a:1>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": "2", "Content-Type": "text/plain", **{k.replace("_", "-"): v for k, v in more.items()}}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\nxy\r\n\r\n").encode()


def test_hostile_headers_are_findings_not_crashes(spark):
    long = [("WARC_Target_URI", "http://" + "a" * 5000 + "/"), ("WARC_Target_URI", "http://" + "a" * N), ("WARC_Segment_Total_Length", "9" * 8000), ("WARC_Record_ID", "<urn:" + "<" * N + "x>"), ("WARC_Payload_Digest", "sha1:" + "=" * N + "x"), ("X_Odd", "=?utf-8?q?" * (N // 10)), ("WARC_IP_Address", "1." * N), ("WARC_Date", "2024-01-01T00:00:00." + "1" * N + "Z")]
    rows = [(bytearray(_record(**{k: v})),) for k, v in long] * 2
    got = P.parse_records(spark.createDataFrame(rows, "content binary"), "content", WarcOptions()).select("block", "error").collect()
    assert len(got) == len(rows) and all(bytes(r.block) == b"xy" and r.error is None for r in got)


@pytest.mark.parametrize("said,held", [("0000000000000000000002", b"xy"), ("+2", b"xy"), ("-2", b""), ("9" * 19, b""), ("9" * 5000, b""), ("2x", b""), ("", b"")])
def test_lengths_however_written(said, held):
    import io

    from warcspark.sources.framing import frames

    row = next(frames(io.BytesIO(_record(Content_Length=said)), WarcOptions()))
    assert row["block"] == held
