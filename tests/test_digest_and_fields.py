import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warcspark.functions import digest as D
from warcspark.functions import fields as H
from warcspark.functions import names as N

DATA = b"Some content"
GOLDEN = {
    ("md5", "base16"): "b53227da4280f0e18270f21dd77c91d0",
    ("md5", "base32"): "WUZCPWSCQDYODATQ6IO5O7ER2A======",
    ("md5", "base64"): "tTIn2kKA8OGCcPId13yR0A==",
    ("sha1", "base16"): "9f1a6ecf74e9f9b1ae52e8eb581d420e63e8453a",
    ("sha1", "base32"): "T4NG5T3U5H43DLSS5DVVQHKCBZR6QRJ2",
    ("sha1", "base64"): "nxpuz3Tp+bGuUujrWB1CDmPoRTo=",
    ("sha256", "base16"): "9c6609fc5111405ea3f5bb3d1f6b5a5efd19a0cec53d85893fd96d265439cd5b",
    ("sha256", "base32"): "TRTAT7CRCFAF5I7VXM6R6222L36RTIGOYU6YLCJ73FWSMVBZZVNQ====",
    ("sha512", "base64"): "sg2XdxjtZ/K/diDuLZgv2FDEiD7I0EhED+e2qGz2Mi/XkcR7DHRp2+7z4zkDLhq8S86+XvwQS8GaEXv+9EeGBQ==",
}


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_golden_digests(spark):
    assert one(spark, *[D.digest(F.lit(DATA), a, e) for a, e in GOLDEN]) == tuple(GOLDEN.values())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.binary(max_size=200))
def test_digests_of_any_bytes(spark, data):
    for a in D.SIZES:
        raw = hashlib.new(a, data).digest()
        want = (raw.hex(), base64.b32encode(raw).decode(), base64.b64encode(raw).decode())
        got = one(spark, *[D.compute(F.lit(data), F.lit(a), F.lit(e)) for e in ("base16", "base32", "base64")])
        assert got == want


@pytest.mark.parametrize(
    "field, ok",
    [
        ("sha1:T4NG5T3U5H43DLSS5DVVQHKCBZR6QRJ2", True),
        ("SHA-1:t4ng5t3u5h43dlss5dvvqhkcbzr6qrj2", True),
        ("sha1:9F1A6ECF74E9F9B1AE52E8EB581D420E63E8453A", True),
        ("md5:tTIn2kKA8OGCcPId13yR0A", True),
        ("md5:ttin2kka8ogccpid13yr0a==", False),
        ("sha256:TRTAT7CRCFAF5I7VXM6R6222L36RTIGOYU6YLCJ73FWSMVBZZVNQ", True),
        ("sha1:T4NG5T3U5H43", False),
        ("sha1", None),
        ("mysecret:12345", None),
        ("blake2:00", None),
        (None, None),
    ],
)
def test_matches(spark, field, ok):
    assert one(spark, D.matches(F.lit(field).cast("string"), F.lit(DATA))) is ok


def test_parse_field(spark):
    for field, want in (("", ("sha256", "base16", "")), ("SHA-512", ("sha512", "base16", "")), ("md5:" + "A" * 32, ("md5", "base16", "a" * 32)), ("md5:" + "a" * 26 + "======", ("md5", "base32", "A" * 26 + "======")), ("sha3:1", (None, "base16", "1"))):
        assert tuple(one(spark, D.parse_field(F.lit(field)))) == want


def _h(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in pairs]) if pairs else F.array().cast("array<struct<name:string,value:string>>")


def _text(spark, h):
    return one(spark, H.serialize(h)).replace("\r\n", ";")


def test_multimap(spark):
    h = _h(("A-B", "1"), ("C", " x"), ("A-B", "2"), ("D", ""))
    assert one(spark, H.get(h, "a-b"), H.get(h, "zz"), H.get(h, "d"), H.has(h, "D"), H.has(h, "E"), H.get_int(h, "A-b"), H.get_int(h, "C")) == ("1", None, "", True, False, 1, None)
    assert one(spark, H.get_all(h, "A-B")) == ["1", "2"]
    assert _text(spark, H.set_(h, "a-b", "9")) == "A-B: 9;C:  x;D: ;"
    assert _text(spark, H.set_(h, "new-ONE", "9")) == "A-B: 1;C:  x;A-B: 2;D: ;New-One: 9;"
    assert _text(spark, H.delete(h, "A-B", "d")) == "C:  x;"
    assert _text(spark, H.sort(_h(("b", "1"), ("a", "2"), ("b", "0")))) == "a: 2;b: 1;b: 0;"
    assert _text(spark, H.add_id(H.add_id(H.set_id(_h(), "x", "urn:1"), "y", ""), "z", "<urn:2")) == "X: <urn:1>;Z: <urn:2;"
    assert _text(spark, H.add_time(_h(), "t", F.lit("2024-01-01 10:00:00.120").cast("timestamp"), fraction=True)) == "T: 2024-01-01T10:00:00.12Z;"
    assert _text(spark, H.set_time(_h(("T", "x")), "t", F.lit("2024-01-01 10:00:00.120").cast("timestamp"))) == "T: 2024-01-01T10:00:00Z;"


def test_names(spark):
    for given_, want in (("warc-type", "WARC-Type"), ("CONTENT-length", "Content-Length"), ("x-fOO", "X-Foo"), ("odd name", "odd name"), ("warc-json-metadata", "WARC-JSON-Metadata")):
        assert one(spark, H.normalize_name(F.lit(given_))) == want
        if " " not in given_:
            assert H.normalize_constant(given_) == want


def test_typed_values(spark):
    ints = [("5", 5), ("+5", 5), ("-5", -5), (" 5", None), ("5x", None), ("99999999999", None), ("", None)]
    assert one(spark, *[H.as_int(F.lit(v)) for v, _ in ints]) == tuple(w for _, w in ints)
    assert one(spark, H.as_int(F.lit("99999999999"), "long")) == 99999999999
    times = [("2017-03-06T04:03:53Z", True), ("2017-03-06T04:03:53.123456789Z", True), ("2017-03-06 04:03:53Z", False), ("2017", False), ("2017-02-30T00:00:00Z", False), ("2017-03-06T04:03:53+01:00", True)]
    assert one(spark, *[H.as_time(F.lit(v)).isNotNull() for v, _ in times]) == tuple(w for _, w in times)
    assert one(spark, H.bare_id(F.lit("<<a>>")), H.type_code(F.lit("RESPONSE")), H.type_name(F.lit(32)), H.type_code(F.lit("x"))) == ("a", 2, "revisit", 0)


def test_file_names(spark):
    t = F.lit("2001-09-12 05:30:20").cast("timestamp")
    assert one(spark, N.file_name(F.lit(1), t, prefix="foo-", host="example")) == "foo-20010912053020-0001-example.warc"
    assert one(spark, N.file_name(F.lit(12), t, pattern="%{mine}s-%06{serial}d.%{ext}s", params={"mine": "m", "ext": "never"}, ext="w")) == "m-000012.w"
    with pytest.raises(ValueError):
        N.file_name(F.lit(1), t, pattern="%{nothing}s")
    assert N.host_or_ip()


def test_lenient_header_text(spark):
    text = "A: 1\r\nB-c : x\r\n\t y \r\nnot a field\r\nD:\r\n\r\nE: body"
    assert _text(spark, H.parse_lenient(F.lit(text))) == "A: 1;B-C: x y;D: ;"
    assert _text(spark, H.parse_lenient(F.lit(""))) == "" and _text(spark, H.parse_lenient(F.lit("A: 1"))) == "A: 1;"
