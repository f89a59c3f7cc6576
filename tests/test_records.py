import gzip

import pytest
from pyspark.sql import functions as F

from tests.test_framing import U, record
from warcspark.functions import fields as H
from warcspark.operators import parse as P
from warcspark.operators import revisit as R
from warcspark.operators import validate as V
from warcspark.operators.build import build_records, marshal
from warcspark.options import WarcOptions
from warcspark.schema import PROFILE_IDENTICAL_1_1, PROFILE_NOT_MODIFIED_1_1, RECORD_COLUMNS

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nX-A: 1\r\n\r\nThe payload"


def parse(spark, data, options=None):
    rows = P.parse_records(spark.createDataFrame([(bytearray(data),)], "content binary"), options=options).collect()
    return rows


def http(body=HTTP, *, kind="response", more="", **kw):
    return record(body, kind=kind, more=more, **kw).replace(b"text/plain\r\n" + more.encode() + b"Content-Length", b"application/http\r\n" + more.encode() + b"Content-Length")


def said(r):
    return [f.msg for f in r.validation]


def test_columns(spark):
    r = parse(spark, http())[0]
    assert r.__fields__ == RECORD_COLUMNS
    assert (r.record_type, r.record_type_code, r.record_id, r.content_length, r.block_kind, r.http.status_code, r.http.status_line) == ("response", 2, U, len(HTTP), "http_response", 200, "200 OK")
    assert bytes(r.block)[r.payload_offset :] == b"The payload" and [tuple(h) for h in r.http.headers] == [("Content-Type", "text/plain"), ("X-A", "1")]
    assert said(r) == [] and r.error is None


@pytest.mark.parametrize("kind, code", [("warcinfo", 1), ("metadata", 16), ("conversion", 64), ("continuation", 128), ("Resource", 4), ("odd", 0)])
def test_types(spark, kind, code):
    r = parse(spark, record(kind=kind))[0]
    assert r.record_type_code == code and r.block_kind == "generic"
    assert said(r) == ([] if code else ["no record type is called 'odd'"])
    assert (parse(spark, record(kind=kind), WarcOptions(unknown_type="fail"))[0].error is not None) == (code == 0)


def test_header_findings(spark):
    def of(more="", kind="response", **kw):
        return [(f.kind, f.field) for f in parse(spark, record(kind=kind, more=more, **kw))[0].validation]

    assert of("WARC-Filename: a\r\n") == [("field", "WARC-Filename")]
    assert of("WARC-IP-Address: 1.2.3\r\n") == [("field", "WARC-IP-Address")]
    assert of("WARC-IP-Address: ::1\r\nWARC-Target-URI: http://a/\r\n") == []
    assert of("WARC-Target-URI: not a uri\r\n") == [("field", "WARC-Target-URI")]
    assert of("WARC-Truncated: a\r\nWARC-Truncated: b\r\n") == [("repeated", "WARC-Truncated")] * 2
    assert of("WARC-Concurrent-To: <urn:a:b>\r\nWARC-Concurrent-To: <urn:a:c>\r\n") == []
    assert ("field", "WARC-Concurrent-To") in of("WARC-Concurrent-To: <urn:a:b>\r\n", kind="warcinfo")
    assert of("WARC-Refers-To-Date: never\r\n", kind="revisit", version="1.0") == []
    assert of("WARC-Refers-To-Date: never\r\n", kind="revisit") == [("field", "WARC-Refers-To-Date")]
    assert of("WARC-Segment-Number: 1x\r\n") == [("field", "WARC-Segment-Number")]
    assert of("WARC-Page-ID: anything\r\nOwn: 1\r\nOwn: 2\r\n") == []
    bad = parse(spark, record(more="WARC-IP-Address: x\r\n", kind="response"), WarcOptions(blank_invalid=True))[0]
    assert {h.name: h.value for h in bad.headers}["WARC-IP-Address"] == ""
    short = parse(spark, b"WARC/1.1\r\n\r\n\r\n\r\n")[0]
    assert [f.field for f in short.validation] == ["WARC-Type", "WARC-Type", "WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type"]
    assert parse(spark, b"WARC/1.1\r\n\r\n\r\n\r\n", WarcOptions.strict())[0].error.kind == "spec"


def test_value_checks(spark):
    cases = [(V.is_long, {"0x1F": True, "0b101": True, "0o17": True, "017": True, "1_000": True, "089": False, "1__0": False, "-5": True, "9223372036854775808": False, "": False}), (V.is_ip, {"1.2.3.4": True, "1.2.3.256": False, "::": True, "::1": True, "1::": True, "2001:db8::8a2e:370:7334": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7:8:9": False, "1::2::3": False, "::ffff:1.2.3.4": True, "fe80::1%e": False, ":1": False, "12345::": False})]
    for check, table in cases:
        got = spark.createDataFrame([(v,) for v in table], "v string").select("v", check(F.col("v")).alias("ok")).collect()
        assert {r.v: r.ok for r in got} == table


def test_digests_and_repairs(spark):
    bad = http(more="WARC-Block-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\nWARC-Payload-Digest: md5:d41d8cd98f00b204e9800998ecf8427e\r\n", length=len(HTTP))
    r = parse(spark, bad)[0]
    assert [(f.kind, f.field) for f in r.validation] == [("digest", "WARC-Block-Digest"), ("digest", "WARC-Payload-Digest")] and said(r)[0].endswith("the header says sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA")
    fixed = parse(spark, bad, WarcOptions(fix_digest=True))[0]
    df = P.parse_records(spark.createDataFrame([(bytearray(bad),)], "content binary"), options=WarcOptions(fix_digest=True))
    again = parse(spark, bytes(df.select(marshal().alias("b")).first().b))[0]
    assert {h.name: h.value for h in fixed.headers}["WARC-Payload-Digest"].startswith("md5:")
    assert said(again) == [] and again.payload_digest.startswith("md5:")
    assert parse(spark, bad, WarcOptions(spec="fail"))[0].error.msg.startswith("the digest of the block is ")
    assert parse(spark, record(more="WARC-Block-Digest: what:1\r\n"), WarcOptions.no_validation())[0].error.msg == "no digest can be computed by what"
    added = parse(spark, http(), WarcOptions(add_missing_digest=True, default_algorithm="sha1", default_encoding="base32"))[0]
    assert {h.name for h in added.headers} >= {"WARC-Block-Digest", "WARC-Payload-Digest"} and added.payload_digest.startswith("sha1:")
    # the end of data comes before the length that was declared
    cut = parse(spark, record(length=99))[0]
    assert any(f.kind == "content_length" for f in cut.validation)
    assert parse(spark, record(length=99), WarcOptions(fix_content_length=True))[0].content_length == 9


def test_http_blocks(spark):
    q = parse(spark, http(b"GET /a?b=1 HTTP/1.0\r\nHost: x\r\n\r\n", kind="request"))[0]
    assert (q.block_kind, q.http.request_uri, q.http.status_code) == ("http_request", "/a?b=1", None)
    open_ = parse(spark, http(b"HTTP/1.1 200 OK\r\nA: b\r\n"))[0]
    assert said(open_) == ["the HTTP header has no empty line at its end"] and open_.http.status_code == 200
    fixed = parse(spark, http(b"HTTP/1.1 200 OK\r\nA: b\r\n"), WarcOptions(fix_syntax_errors=True))[0]
    assert bytes(fixed.block).endswith(b"A: b\r\n\r\n") and fixed.content_length == len(fixed.block)
    assert parse(spark, http(b"HTTP/1.1 200 OK\r\nA: b\r\n"), WarcOptions.strict())[0].error.kind == "syntax"
    assert parse(spark, http(b"abc"))[0].error.msg == "the block is too short for an HTTP message"
    assert said(parse(spark, http(b"HTTP/1.1\r\n\r\n"), WarcOptions(block="warn"))[0]) == ["the first line can't be read as that of an http response"]
    assert said(parse(spark, http(b"HTTP/1.1\r\n\r\n"))[0]) == []
    many = b"HTTP/1.1 200 OK\n" + b"A: b\n" * 20000 + b"\nX"
    assert parse(spark, http(many))[0].payload_offset == len(many) - 1
    assert parse(spark, http(), WarcOptions.no_validation())[0].block_kind == "generic"


def test_warc_fields(spark):
    data = record(b"software: x\nnext: y\r\n", kind="warcinfo").replace(b"text/plain", b"application/warc-fields")
    r = parse(spark, data, WarcOptions(block="warn"))[0]
    assert [tuple(f) for f in r.warc_fields] == [("Software", "x"), ("Next", "y")] and [(f.line, f.msg) for f in r.validation] == [(1, "the line doesn't end in a carriage return")]
    fixed = parse(spark, data, WarcOptions(fix_warc_fields=True, fix_content_length=True))[0]
    assert bytes(fixed.block) == b"Software: x\r\nNext: y\r\n" and fixed.content_length == len(fixed.block)


def test_marshal_round_trip(spark):
    a = http(more="X-Own: é\r\n") + gzip.compress(record(b"\x00\xff\r\n\r\n")) + record(b"")
    rows = P.parse_records(spark.createDataFrame([(bytearray(a),)], "content binary"))
    back = rows.select(marshal().alias("b")).collect()
    assert b"".join(bytes(r.b) for r in back) == http(more="X-Own: é\r\n") + record(b"\x00\xff\r\n\r\n") + record(b"")
    again = P.parse_records(spark.createDataFrame([(bytearray(b"".join(bytes(r.b) for r in back)),)], "content binary"))
    keep = [c for c in RECORD_COLUMNS if c not in ("record_offset", "record_size", "is_gzip", "file_path")]
    assert rows.select(*keep).collect() == again.select(*keep).collect()


def test_headers_only_and_one_record(spark):
    df = spark.createDataFrame([(bytearray(http() + http()), 7), (None, 0)], "content binary, base long")
    h = P.headers_only(df, base="base").collect()
    assert [r.record_offset for r in h] == [7, 7 + len(http())] and "block" not in h[0].__fields__
    assert P.parse_record(df).count() == 1
    assert P.findings(P.parse_records(spark.createDataFrame([(bytearray(b"XX" + record()),)], "content binary"))).first().msg.startswith("2 bytes stand before")


def test_builder(spark):
    df = spark.createDataFrame([(1, "text", None), (2, "more", "<urn:own:2>")], "id long, body string, rid string")
    rows = build_records(df, "resource", "body", {"warc-record-id": F.col("rid"), "WARC-Date": "2024-01-01T00:00:00Z", "content-type": "text/plain"}, keep=("id",)).orderBy("id").collect()
    assert rows[0].record_id.startswith("urn:uuid:") and rows[1].record_id == "urn:own:2" and [r.content_length for r in rows] == [4, 4]
    assert all(said(r) == [] for r in rows)
    fixed = build_records(df, "resource", "body", {}, WarcOptions(record_id=F.concat(F.lit("urn:x:"), F.lit("1")))).first()
    assert fixed.record_id == "urn:x:1" and [f.field for f in fixed.validation] == ["WARC-Date", "Content-Type"]
    bare = build_records(df, "resource", "body", {}, WarcOptions(add_missing_record_id=False, add_missing_content_length=False, spec="fail")).first()
    assert bare.error.kind == "spec"
    with pytest.raises(ValueError):
        build_records(df, "nothing", "body")


def _record(spark, data=None):
    return P.parse_records(spark.createDataFrame([(bytearray(data or http(more="WARC-Payload-Digest: sha1:c37ffb221569c553a2476c22c7dad429f3492977\r\nWARC-Target-URI: http://a/\r\n")),)], "content binary"), options=WarcOptions(spec="ignore"))


def test_to_revisit_and_merge(spark):
    full = _record(spark)
    rv = R.to_revisit(full.withColumn("ref", R.create_revisit_ref()))
    r = rv.first()
    h = {x.name: x.value for x in r.headers}
    assert (r.record_type, r.block_kind, h["WARC-Profile"], h["WARC-Truncated"], h["WARC-Refers-To"], h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"]) == ("revisit", "revisit", PROFILE_IDENTICAL_1_1, "length", f"<{U}>", "http://a/", "2017-03-06T04:03:53Z")
    assert bytes(r.block) == HTTP[: HTTP.index(b"The")] and h["Content-Length"] == str(len(r.block))
    assert tuple(rv.select(R.revisit_ref().alias("r")).first().r) == (PROFILE_IDENTICAL_1_1, U, "http://a/", "2017-03-06T04:03:53Z")
    m = R.merge(rv.drop("ref"), full).first()
    hm = {x.name: x.value for x in m.headers}
    assert bytes(m.block) == HTTP and m.record_type == "response" and m.error is None and hm["Content-Length"] == str(len(HTTP))
    assert not {"WARC-Refers-To", "WARC-Profile", "WARC-Truncated", "WARC-Refers-To-Date"} & set(hm)
    again = R.merge(rv.drop("ref"), full.withColumn("headers", H.set_("headers", "WARC-Block-Digest", "sha1:X")), keep_block_digest=True).first()
    assert {x.name: x.value for x in again.headers}["WARC-Block-Digest"] == "sha1:X"


def test_revisit_errors(spark):
    full = _record(spark)
    assert R.to_revisit(full.withColumn("ref", R.create_revisit_ref("http://odd/"))).first().error.kind == "profile"
    assert R.to_revisit(_record(spark, http()).withColumn("ref", R.create_revisit_ref())).first().error.kind == "digest"
    assert R.to_revisit(_record(spark, http()).withColumn("ref", R.create_revisit_ref(PROFILE_NOT_MODIFIED_1_1))).first().record_type == "revisit"
    lent = R.to_revisit(_record(spark, record(more="WARC-Block-Digest: sha1:B\r\n")).withColumn("ref", R.create_revisit_ref())).first()
    assert {x.name: x.value for x in lent.headers}["WARC-Payload-Digest"] == "sha1:B" and bytes(lent.block) == b""
    rv = R.to_revisit(full.withColumn("ref", R.create_revisit_ref())).drop("ref")
    assert R.merge(full, full).first().error.msg.startswith("only a revisit")
    assert "no record" in R.merge(rv, full.limit(0)).first().error.msg
    several = R.merge(rv, full.unionByName(full)).collect()
    assert len(several) == 1 and several[0].record_type == "revisit" and "several" in several[0].error.msg
    assert "HTTP blocks" in R.merge(rv, _record(spark, record())).first().error.msg
    seg = rv.withColumn("headers", H.set_("headers", "WARC-Segment-Number", "1"))
    assert "segments" in R.merge(seg, full).first().error.msg
    assert R.dangling(rv, full).count() == 0 and R.dangling(rv, full.limit(0)).count() == 1 and R.referenced(full, rv).count() == 1
    assert rv.select(R.create_revisit_ref().alias("r")).first().r is None and full.select(R.revisit_ref().alias("r")).first().r is None


def test_cut_blocks_are_not_judged(spark):
    """A block beyond max_block_bytes is cut: its length and digests are neither checked nor repaired nor computed."""
    sound = record(b"0123456789" * 20, more="WARC-Block-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\n")
    for o in (WarcOptions(max_block_bytes=50), WarcOptions(max_block_bytes=50, fix_digest=True, fix_content_length=True, add_missing_digest=True)):
        r = parse(spark, sound, o)[0]
        assert r.block_truncated and len(r.block) == 50 and said(r) == [] and r.content_length == 200 and r.block_digest is None
        assert {h.name: h.value for h in r.headers}["WARC-Block-Digest"] == "sha1:" + "A" * 32
    assert [f.kind for f in parse(spark, sound)[0].validation] == ["digest"]


def test_names_are_spelled_alike_in_both_parsers(spark):
    names = ["foo bar-baz", "a--b", "X_y-z", "warc-date", "(odd)-name", "über-name", "-x-", "e\u0301-x"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", H.normalize_name("n").alias("m")).collect()
    assert {r.n: r.m for r in got} == {n: H.normalize_constant(n) for n in names}


def test_set_many_is_one_set_after_the_other(spark):
    import itertools

    pairs = [("A", "1"), ("B", "2"), ("A", "3"), ("C", "")]
    changes = [("a", F.lit("x")), ("D", F.lit("y")), ("c", F.lit(None).cast("string")), ("B", F.lit("z"))]
    df = spark.createDataFrame([([{"name": n, "value": v} for n, v in p],) for k in range(5) for p in itertools.permutations(pairs, k)], "h array<struct<name:string,value:string>>")
    one = F.col("h")
    for n, v in changes:
        one = H.set_(one, n, v) if n != "c" else one
    gone = H.delete(one, "C")
    got = df.select(H.set_many("h", changes).alias("a"), one.alias("b"), H.set_many("h", changes, keep_missing=False).alias("c"), gone.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and len(got) == 65


def test_encoded_words(spark):
    from email.header import decode_header

    words = ["=?utf-8?B?Y2Fmw6k=?=", "=?ISO-8859-1?q?caf=E9_x?= tail", "a =?us-ascii?Q?b?= =?utf-8?b?Yw==?= d", "=?koi8-r?Q?x?=", "=?utf-8?B?!?=", "none", "=?utf-8?Q?=FF?=", ""]
    got = {r.w: r.d for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", H.decode_words("w").alias("d")).collect()}
    plain = {w: "".join(p if isinstance(p, str) else p.decode(c or "ascii") for p, c in decode_header(w)) for w in words[:3]}
    assert [got[w] for w in words[:3]] == [plain[w] for w in words[:3]]
    assert all(got[w] == w for w in words[3:])


def test_headers_as_json(spark):
    h = H.fields([("A", F.lit("1")), ("b-c", F.lit('quo"te')), ("a", F.lit("2"))])
    r = spark.range(1).select(H.to_json(h).alias("j"), H.from_json(H.to_json(h)).alias("h")).first()
    assert r.j == '{"A":["1","2"],"B-C":["quo\\"te"]}' and [tuple(x) for x in r.h] == [("A", "1"), ("A", "2"), ("B-C", 'quo"te')]
