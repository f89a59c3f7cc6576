"""The registered queries of the archive engine and their SQL.

All run over whole tables. Captures are made from `pages`: an HTTP response for each, dated a
second after the one before, with a status by page_id.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import digest as D
from ..functions import fields as H
from ..functions import names as N
from ..operators import analytics as A
from ..operators import captures as captures_index
from ..operators import parse as P
from ..operators import revisit as R
from ..operators import validate as V
from ..operators.build import build_records, http_response, marshal
from ..options import WarcOptions
from ..sources import sink as K
from ..sources.datasource import WarcDataSource, block_chunks, load
from ..sources.udtf import register
from ..storage import scratch
from ..streaming import deduplicate_stream, first_captures, sessions, windowed_counts

#: Bytes of a file that a range has, where a query doesn't name another size.
RANGE = 8 << 20

STATUS = ("200 OK", "301 Moved Permanently", "404 Not Found", "500 Internal Server Error")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _by(n: Column, *values: object) -> Column:
    """The value at n modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _status(page_id: Column) -> Column:
    return _by(page_id, *STATUS)


def _date(n: Column) -> Column:
    return H.rfc3339(F.timestamp_seconds(F.lit(1704067200) + n))


def _utc(time: Column) -> Column:
    """UTC wall clock as text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def _body() -> Column:
    fields = {"Content-Type": "text/html; charset=utf-8", "Content-Length": F.octet_length("html").cast("string")}
    return http_response(_status(F.col("page_id")), fields, F.col("html"))


def _headers(**more: Column) -> dict[str, Column]:
    return {
        "WARC-Record-ID": F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        "WARC-Date": _date(F.col("page_id")),
        "WARC-Target-URI": F.col("url"),
        "Content-Type": F.lit("application/http; msgtype=response"),
        **{k.replace("_", "-"): v for k, v in more.items()},
    }


def captures_of(pages: DataFrame, options: WarcOptions | None = None, **more: Column) -> DataFrame:
    return build_records(pages, "response", _body(), _headers(**more), options, keep=("page_id",))


def captures(spark: SparkSession, sf: str, options: WarcOptions | None = None, **more: Column) -> DataFrame:
    return captures_of(_t(spark, sf, "pages"), options, **more)


def _archive(spark: SparkSession, sf: str, *, gz: bool = True) -> DataFrame:
    """page_id and the bytes of each capture, a gzip member of its own."""
    d = captures(spark, sf).select("page_id", marshal().alias("bytes"))
    return K.compress_records(d) if gz else d


def q01_roundtrip_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = P.parse_records(_archive(spark, sf), "bytes")
    return r.groupBy("record_type", F.col("http.status_code").alias("status_code")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("block") - F.col("payload_offset")).alias("payload_bytes"))


def q02_content_length(spark: SparkSession, sf: str) -> DataFrame:
    return captures(spark, sf).select("page_id", "content_length", "block_size", F.col("payload_offset").cast("long").alias("head_bytes"))


def _digests(algorithm: str, encoding: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _t(spark, sf, "pages").select("page_id", D.digest("html", algorithm, encoding).alias("digest"))

    return run


def q06_digest_validate(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("page_id") % 5 == 0, F.lit("sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA")).otherwise(D.digest_field(F.col("html"), "sha1"))
    r = captures(spark, sf, WARC_Payload_Digest=said)
    f = F.get("validation", F.lit(0))
    return r.select("page_id", F.size("validation").alias("findings"), f["field"].alias("field"), f["expected"].alias("expected"), f["actual"].alias("actual"))


_CODED = (("md5", 32), ("md5", 26), ("md5", 24), ("sha1", 40), ("sha1", 32), ("sha1", 28), ("sha256", 64), ("sha256", 52), ("sha512", 86), ("sha512", 7))


def q07_detect_encoding(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", _by(F.col("doc_id"), *[a for a, _ in _CODED]).alias("algorithm"), F.repeat(F.lit("a"), _by(F.col("doc_id"), *[n for _, n in _CODED])).alias("value"))
    return d.select("doc_id", "algorithm", D.detect_encoding("algorithm", "value", "base16").alias("encoding"))


def _multi(spark: SparkSession, sf: str) -> DataFrame:
    h = H.fields([("warc-target-uri", F.col("url")), ("X-tag", F.col("page_id").cast("string")), ("x-TAG", F.concat(F.lit("b"), F.col("page_id").cast("string"))), ("Content-Type", F.when(F.col("page_id") % 2 == 0, "text/html"))])
    return _t(spark, sf, "pages").select("page_id", "url", h.alias("headers"))


def q08_header_get(spark: SparkSession, sf: str) -> DataFrame:
    return _multi(spark, sf).select("page_id", H.get("headers", "WARC-TARGET-URI").alias("uri"), H.has("headers", "content-type").alias("has_type"), F.array_join(H.get_all("headers", "X-Tag"), "|").alias("tags"), H.get_int("headers", "x-tag").alias("tag"), H.get_int64("headers", "WARC-Target-URI").alias("no_int"))


def q09_header_set_delete(spark: SparkSession, sf: str) -> DataFrame:
    h = H.delete(H.add(H.set_("headers", "X-Tag", "new"), "Last", "z"), "Content-Type")
    h = H.add_id(H.set_int(h, "Content-Length", F.col("page_id")), "WARC-Refers-To", F.concat(F.lit("urn:"), F.col("page_id").cast("string")))
    return _multi(spark, sf).select("page_id", H.serialize(h).alias("text"))


def q10_header_sort(spark: SparkSession, sf: str) -> DataFrame:
    return _multi(spark, sf).select("page_id", F.array_join(F.transform(H.sort("headers"), lambda x: F.concat_ws("=", x["name"], x["value"])), ";").alias("text"))


_NAMES = {"warc-TYPE": "WARC-Type", "content-length": "Content-Length", "x-foo-BAR": "X-Foo-Bar", "warc-ip-address": "WARC-IP-Address", "etag": "Etag", "WARC-RECORD-id": "WARC-Record-ID"}


def q11_normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *_NAMES).alias("given"))
    return e.select("event_id", "given", H.normalize_name("given").alias("name"))


_TYPES = {"view": "Response", "signup": "REQUEST", "click": "revisit", "error": "nothing", "purchase": ""}


def q12_record_types(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", H.fields([("WARC-Type", _case("event_type", _TYPES))]).alias("headers"))
    code, found = V.resolve_type("headers", WarcOptions())
    return e.select("event_id", code.alias("code"), H.type_name(code).alias("record_type"), F.size(found).alias("findings"))


def _case(col: str, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def _findings(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode("validation").alias("f")).select(*keep, F.col("f.kind").alias("kind"), F.col("f.field").alias("field"))


def q13_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    h = {"WARC-Record-ID": F.when(p % 3 != 0, F.lit("<urn:a:b>")), "WARC-Date": F.when(p % 4 != 0, F.lit("2024-01-01T00:00:00Z")), "Content-Type": F.when(p % 5 != 0, F.lit("text/html"))}
    r = build_records(_t(spark, sf, "pages"), "resource", "html", h, WarcOptions(add_missing_record_id=False), keep=("page_id",))
    return _findings(r, "page_id").groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


def q14_illegal_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    more = {"WARC_Filename": F.when(p % 2 == 0, F.lit("a.warc")), "WARC_Profile": F.when(p % 3 == 0, F.lit("http://a.b/c")), "WARC_Segment_Origin_ID": F.when(p % 5 == 0, F.lit("<urn:x:y>")), "WARC_Page_ID": F.lit("free")}
    return _findings(captures(spark, sf, **more), "page_id")


def q15_duplicate_fields(spark: SparkSession, sf: str) -> DataFrame:
    h = _headers()
    twice = H.fields([*h.items(), ("WARC-Truncated", F.lit("length")), ("WARC-Truncated", F.when(F.col("page_id") % 2 == 0, F.lit("time"))), ("WARC-Concurrent-To", F.lit("<urn:a:1>")), ("WARC-Concurrent-To", F.lit("<urn:a:2>"))])
    r = build_records(_t(spark, sf, "pages"), "response", _body(), twice, keep=("page_id",))
    return _findings(r, "page_id")


_DATES = ("2024-02-29T12:00:00Z", "2023-13-01T00:00:00Z", "2024-01-01", "2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00.5Z", "yesterday")


def q16_date_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *_DATES).alias("given"))
    return e.select("event_id", V.is_time(F.col("given")).alias("ok"), _utc(H.as_time("given")).alias("utc"))


_IDS = ("<urn:uuid:1>", "urn:uuid:1", "<urn:uuid:1", "<<urn:uuid:1>>", "<nothing>", "<http://a/b c>")


def q17_id_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *_IDS).alias("given"))
    return e.select("event_id", V.is_id(F.col("given")).alias("ok"), H.bare_id("given").alias("bare"), H.bracketed(F.col("given")).alias("bracketed"))


_IPS = ("127.0.0.1", "256.1.1.1", "1.2.3", "::1", "2001:db8::8a2e:370:7334", "1::2::3", "::ffff:10.0.0.1", "fe80::1%eth0")


def q18_ip_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *_IPS).alias("given"))
    return e.select("event_id", "given", V.is_ip(F.col("given")).alias("ok"))


def q19_uri_host(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", V.is_uri(F.col("url")).alias("ok"), A.host("url").alias("host"))


def q20_fix_content_length(spark: SparkSession, sf: str) -> DataFrame:
    wrong = F.when(F.col("page_id") % 3 == 0, F.lit("7"))
    r = captures(spark, sf, WarcOptions(fix_content_length=True), Content_Length=wrong)
    return r.select("page_id", "content_length", F.size("validation").alias("findings"))


def q21_fix_digest(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    said = F.when(p % 3 == 0, F.lit("sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA")).when(p % 3 == 1, F.upper(F.concat(F.lit("md5:"), F.md5(F.col("html").cast("binary")))))
    h = {"WARC-Record-ID": F.lit("<urn:a:b>"), "WARC-Date": F.lit("2024-01-01T00:00:00Z"), "Content-Type": F.lit("text/html"), "WARC-Block-Digest": said}
    r = build_records(_t(spark, sf, "pages"), "resource", "html", h, WarcOptions(fix_digest=True, add_missing_digest=True), keep=("page_id",))
    return r.select("page_id", H.get("headers", "WARC-Block-Digest").alias("digest"), F.size("validation").alias("findings"))


def q22_fix_http_separator(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nX-Page: "), F.col("page_id").cast("string"), F.lit("\r\n"), F.when(F.col("page_id") % 2 == 0, "\r\n").otherwise(""))
    r = build_records(_t(spark, sf, "pages"), "response", F.encode(head, "UTF-8"), _headers(), WarcOptions(fix_syntax_errors=True), keep=("page_id",))
    return r.select("page_id", "content_length", "block_size", F.size("validation").alias("findings"), F.get("http.headers", F.lit(0))["value"].alias("page"))


def q23_folded_header_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The strict parser on bytes and the expression on text, side by side."""
    text = F.concat(F.lit("WARC-Type: metadata\r\nx-page: a\r\n\t b"), F.col("page_id").cast("string"), F.lit("\r\n   c\r\nWARC-Target-URI:  "), F.col("url"), F.lit("  \r\n\r\nNot-A: header\r\n"))
    d = _t(spark, sf, "pages").select("page_id", text.alias("text"), F.encode(F.concat(F.lit("WARC/1.1\r\n"), text), "UTF-8").alias("bytes"))
    strict = P.frame(d, "bytes", WarcOptions(), base="page_id", one=True).select(F.col("record_offset").alias("page_id"), H.serialize("headers").alias("strict"))
    return d.select("page_id", H.serialize(H.parse_lenient("text")).alias("lenient")).join(strict, "page_id")


def q24_http_status(spark: SparkSession, sf: str) -> DataFrame:
    return captures(spark, sf).select("page_id", F.col("http.status_line").alias("status_line"), F.col("http.status_code").alias("status_code"), F.get("http.headers", F.lit(0))["value"].alias("content_type"))


def q25_http_request_uri(spark: SparkSession, sf: str) -> DataFrame:
    block = F.encode(F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.0\r\nHost: a\r\n\r\n")), "UTF-8")
    h = {**_headers(), "Content-Type": F.lit("application/http; msgtype=request")}
    r = build_records(_t(spark, sf, "pages"), "request", block, h, keep=("page_id",))
    return r.select("page_id", "block_kind", F.col("http.request_uri").alias("request_uri"))


def q26_payload_split(spark: SparkSession, sf: str) -> DataFrame:
    r = captures(spark, sf)
    return r.select("page_id", F.col("payload_offset").cast("long").alias("payload_offset"), F.md5(B.payload("block", "payload_offset")).alias("payload_md5"))


def q27_warc_fields_block(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.concat(F.lit("name: "), F.col("p_name"), F.lit("\r\nbrand: "), F.col("p_brand"), F.lit("\r\nsize: "), F.col("p_size").cast("string"), F.lit("\r\n"))
    h = {"WARC-Record-ID": F.lit("<urn:a:b>"), "WARC-Date": F.lit("2024-01-01T00:00:00Z"), "Content-Type": F.lit("application/warc-fields")}
    r = build_records(_t(spark, sf, "part"), "warcinfo", F.encode(lines, "UTF-8"), h, keep=("p_partkey",))
    return r.select("p_partkey", F.explode("warc_fields").alias("f")).select("p_partkey", F.col("f.name").alias("name"), F.col("f.value").alias("value"))


def q28_record_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets by arithmetic; files of 50 pages each."""
    r = _t(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 50).cast("long").alias("file"), F.octet_length("html").cast("long").alias("n"))
    return A.running_offsets(r, F.col("n"), file=["file"], order=["page_id"])


def q29_gzip_members(spark: SparkSession, sf: str) -> DataFrame:
    """Archives of up to 20 members each, read back record by record."""
    z = _archive(spark, sf).withColumn("g", F.floor(F.col("page_id") / 20).cast("long"))
    r = P.parse_records(K.concat_archive(z, "bytes", "g", "page_id").withColumn("name", F.col("g").cast("string")), "content", path="name")
    return r.groupBy(F.col("file_path").cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("block") - F.col("payload_offset")).alias("payload_bytes"), F.sum(F.size("validation")).alias("findings"), F.count_if(F.col("is_gzip")).alias("members"))


def q30_resync_after_garbage(spark: SparkSession, sf: str) -> DataFrame:
    d = _archive(spark, sf, gz=False).select("page_id", F.concat(F.encode(F.repeat(F.lit("#"), (F.col("page_id") % 7).cast("int")), "UTF-8"), F.col("bytes"), F.lit(b"trailing garbage")).alias("bytes"), F.col("page_id").cast("string").alias("name"))
    r = P.parse_records(d, "bytes", path="name")
    return r.select(F.col("file_path").cast("long").alias("page_id"), "record_type", "skipped_bytes", "record_offset", F.size("validation").alias("findings"), F.col("error.kind").alias("error"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as HTTP responses with a payload digest."""
    d = _t(spark, sf, "documents").withColumnRenamed("text", "html").withColumn("page_id", F.col("doc_id")).withColumn("url", F.concat(F.lit("http://docs.example/"), F.col("doc_id").cast("string")))
    h = _headers(WARC_Payload_Digest=D.digest_field("html", "sha256"))
    return build_records(d, "response", _body(), h, keep=("doc_id",))


def q31_to_revisit(spark: SparkSession, sf: str) -> DataFrame:
    r = R.deduplicate(_documents(spark, sf))
    return r.select("doc_id", "record_type", R.revisit_ref()["target_record_id"].alias("refers_to"), (F.col("block_size") == F.col("payload_offset")).alias("no_payload"))


def q32_merge_revisits(spark: SparkSession, sf: str) -> DataFrame:
    """Every repeated document made a revisit of the first one and merged back."""
    full = _documents(spark, sf)
    d = R.deduplicate(full)
    m = R.merge(d.where("record_type = 'revisit'"), full.drop("doc_id"))
    return m.select("doc_id", "record_type", F.md5(B.payload("block", "payload_offset")).alias("payload_md5"), F.col("error.kind").alias("error"), (F.col("content_length") == F.octet_length("block")).alias("length_ok"))


def _revisits(spark: SparkSession, sf: str) -> DataFrame:
    """A revisit for each label, of the document that it names; ids from 2000 on name nothing that exists."""
    t = _t(spark, sf, "labels")
    target = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))
    h = {"WARC-Record-ID": F.concat(F.lit("<urn:label:"), F.col("doc_id").cast("string"), F.lit(">")), "WARC-Date": _date(F.col("doc_id")), "WARC-Refers-To": F.concat(F.lit("<urn:page:"), target.cast("string"), F.lit(">")), "Content-Type": F.lit("message/http"), "WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")}
    return build_records(t, "revisit", F.lit(b""), h, keep=("doc_id",))


def q33_dangling_revisits(spark: SparkSession, sf: str) -> DataFrame:
    return R.dangling(_revisits(spark, sf), _documents(spark, sf)).select("doc_id")


def q34_referenced_records(spark: SparkSession, sf: str) -> DataFrame:
    return R.referenced(_documents(spark, sf), _revisits(spark, sf)).select("doc_id")


def q35_rolling_files(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "pages").select("page_id", F.octet_length("html").alias("n"))
    out = K.plan_files(d, order=("page_id",), max_file_size=65536, size=F.col("n"), estimated=F.col("n"))
    return out.select("page_id", "file_number", "file_offset")


def q36_concurrent_to(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations")
    h = {"WARC-Record-ID": F.concat(F.lit("<urn:c:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(">")), "WARC-Date": F.lit("2024-01-01T00:00:00Z"), "Content-Type": F.lit("text/plain")}
    r = K.add_concurrent_to(build_records(c, "resource", "text", h, keep=("conv_id", "turn")), "conv_id")
    return r.select("conv_id", "turn", F.array_join(H.get_all("headers", "WARC-Concurrent-To"), " ").alias("others"))


def q37_warcinfo_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are really written, two writers, and read back by the data source."""
    folder = scratch(spark, "archive")
    o = K.WriterOptions(max_file_size=0, prefix="q-", host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC), warcinfo=(("software", "warcspark"),))
    K.write_archives(captures(spark, sf), folder, o, writers=2)
    r = load(spark, folder)
    return r.groupBy(F.element_at(F.split("file_path", "/"), -1).alias("file_name")).agg(F.count_if(F.col("record_type") == "warcinfo").alias("infos"), (F.count_if(F.col("record_type") == "response") > 0).alias("has_records"), F.count_if(H.has("headers", "WARC-Warcinfo-ID") == (F.col("record_type") == "warcinfo")).alias("odd"), F.sum(F.size("validation")).alias("findings")).drop("has_records")


def q38_file_names(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select("event_id", N.file_name(F.col("event_id") + 1, F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")), prefix="foo-", host="example").alias("file_name"))


def q39_as_of_capture(spark: SparkSession, sf: str) -> DataFrame:
    """For each event, the latest page at that time whose id shares the event's remainder by 10."""
    e = _t(spark, sf, "events").select("event_id", (F.col("event_id") % 10).alias("k"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    p = _t(spark, sf, "pages").select("page_id", (F.col("page_id") % 10).alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id as int))").alias("at"))
    return A.as_of(e, p, by="k", left_time="ts", right_time="at", value="page_id", out="page_id", bucket=lambda t: F.date_trunc("day", t)).select("event_id", "page_id")


def q40_host_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "pages").select(A.host("url").alias("host"), _status(F.col("page_id")).alias("status"), F.octet_length("html").alias("n"))
    return d.rollup("host", "status").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").cast("long").alias("bytes"))


def q41_cube(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("lang", (F.col("n_chars") > 2000).alias("long_text"))
    return d.cube("lang", "long_text").agg(F.count(F.lit(1)).alias("n"))


def q42_top_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """A report of ten rows: the limit is the feature."""
    d = _t(spark, sf, "pages").groupBy(A.host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), "host").limit(10)


def q43_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id")
    labelled = _t(spark, sf, "labels").select("doc_id")
    only = d.exceptAll(labelled).select("doc_id", F.lit("unlabelled").alias("part"))
    return only.unionByName(d.intersect(labelled).select("doc_id", F.lit("labelled").alias("part")))


def q44_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the events that runs to its end; the counts of every window, written when it closes."""
    where = scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(source, "ts", "1 hour", ["event_type"], late="1 hour").drop("window_end")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{where}/out/part={number}")

    counts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{where}/out/*")
    return out.groupBy("window_start", "event_type").agg(F.max("n").alias("n")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def q45_bit_mask_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", H.type_code(_case("event_type", _TYPES)).alias("record_type_code"))
    return A.of_types(e, "response", "revisit").groupBy("record_type_code").agg(F.count(F.lit(1)).alias("n"))


def q46_join_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each page cut into three records and put together again."""
    d = _t(spark, sf, "pages").select("page_id", "html", F.ceil(F.length("html") / 3).cast("int").alias("w"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i"))
    part = F.substring("html", (F.col("i") - 1) * F.col("w") + 1, F.when(F.col("i") == 3, F.length("html")).otherwise(F.col("w")))
    origin = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    h = {"WARC-Record-ID": F.when(F.col("i") == 1, origin).otherwise(F.concat(F.lit("<urn:part:"), F.col("page_id").cast("string"), F.lit(":"), F.col("i").cast("string"), F.lit(">"))), "WARC-Segment-Origin-ID": F.when(F.col("i") > 1, origin), "WARC-Segment-Number": F.col("i").cast("string")}
    kind = F.when(F.col("i") == 1, F.lit("resource")).otherwise(F.lit("continuation"))
    r = A.join_segments(build_records(d, kind, F.encode(part, "UTF-8"), h))
    return r.select(F.regexp_extract("origin_id", r"(\d+)$", 1).cast("long").alias("page_id"), "segments", F.md5("block").alias("md5"))


def q47_digest_sha512(spark: SparkSession, sf: str) -> DataFrame:
    """DuckDB has no SHA-512: the tests hold this against golden values."""
    return _t(spark, sf, "pages").select("page_id", D.digest("html", "sha512", "base64").alias("digest"))


def q48_headers_only(spark: SparkSession, sf: str) -> DataFrame:
    r = P.headers_only(_archive(spark, sf), "bytes")
    return r.select(F.regexp_extract("record_id", r"(\d+)$", 1).cast("long").alias("page_id"), "record_type", "content_length", _utc(F.col("warc_date")).alias("warc_date"), "target_uri")


def _in_order(spark: SparkSession, sf: str, name: str) -> tuple[str, DataFrame]:
    """A folder with all captures in one plain file, by page_id, and its manifest."""
    folder = scratch(spark, name)
    o = K.WriterOptions(max_file_size=0, compress=False, host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC))
    return folder, K.write_archives(captures(spark, sf), folder, o, writers=1, order=("page_id",))


def _page() -> Column:
    return F.regexp_extract("record_id", r"(\d+)$", 1).cast("long").alias("page_id")


def q49_start_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Reading from the place of the third record on."""
    folder, manifest = _in_order(spark, sf, "from-offset")
    third = manifest.orderBy("file_offset").limit(3).agg(F.max("file_offset")).first()[0]
    return load(spark, folder, offset=str(third), split_bytes=RANGE).select(_page(), "record_type", "content_length")


def q50_first_record(spark: SparkSession, sf: str) -> DataFrame:
    """One record of each row, whatever follows it."""
    d = _archive(spark, sf, gz=False).select(F.concat("bytes", "bytes", F.lit(b"garbage")).alias("bytes"))
    return P.parse_record(d, "bytes").select(_page(), "record_offset", (F.col("record_size") == F.col("block_size") + F.octet_length(marshal(block=F.lit(b"")))).alias("size_ok"), F.size("validation").alias("findings"))


def q51_groups_stay_together(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of a conversation are written by one writer, next to each other in their order."""
    c = _t(spark, sf, "conversations")
    h = {"WARC-Record-ID": F.concat(F.lit("<urn:c:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.lit(">")), "WARC-Date": F.lit("2024-01-01T00:00:00Z"), "Content-Type": F.lit("text/plain")}
    o = K.WriterOptions(max_file_size=0, host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC))
    m = K.write_archives(build_records(c, "resource", "text", h, keep=("conv_id", "turn")), scratch(spark, "groups"), o, writers=4, group="conv_id", order=("conv_id", "turn"))
    parts = F.split("record_id", ":")
    m = m.select(parts[2].cast("long").alias("conv_id"), parts[3].cast("long").alias("turn"), "file_name", "file_offset")
    last = F.max(F.struct("file_offset", "turn"))["turn"]
    return m.groupBy("conv_id").agg(F.countDistinct("file_name").alias("files"), F.count(F.lit(1)).alias("turns"), (last == F.max("turn")).alias("in_order"))


def q52_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs into one folder: each starts files of its own, and the manifest holds both."""
    folder, when = scratch(spark, "rotated"), datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)
    for prefix in ("a-", "b-"):
        m = K.write_archives(captures(spark, sf), folder, K.WriterOptions(prefix=prefix, host="example", time=when), writers=1)
    return m.groupBy("file_name").agg(F.count(F.lit(1)).alias("records"), F.min("file_offset").alias("first"))


def q53_add_times(spark: SparkSession, sf: str) -> DataFrame:
    t = F.timestamp_micros(F.lit(1704067200000000) + F.col("event_id") * 250000)
    h = H.add_time(H.add_time(H.fields([]), "WARC-Date", t), "X-Fine", t, fraction=True)
    return _t(spark, sf, "events").select("event_id", H.get(h, "WARC-Date").alias("seconds"), H.get(h, "X-Fine").alias("fraction"))


_VERSIONS = ("1.0", "1.1", "0.17", "2.0")


def q54_versions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("WARC/"), _by(F.col("page_id"), *_VERSIONS), F.lit("\r\nWARC-Type: metadata\r\nContent-Length: 0\r\nX-Page: "), F.col("page_id").cast("string"), F.lit("\r\n\r\n\r\n\r\n"))
    r = P.frame(_t(spark, sf, "pages").select(F.encode(text, "UTF-8").alias("b")), "b", WarcOptions())
    return r.select(H.get_int64("headers", "X-Page").alias("page_id"), "version", "version_major", "version_minor", F.size("before").alias("findings"))


def q55_broken_gzip(spark: SparkSession, sf: str) -> DataFrame:
    """Members that end early: a fatal error, said once for each archive."""
    d = _archive(spark, sf).select(F.col("page_id").cast("string").alias("name"), F.expr("substring(bytes, 1, int(octet_length(bytes) / 2))").alias("bytes"))
    return P.parse_records(d, "bytes", path="name").select(F.col("file_path").cast("long").alias("page_id"), F.col("error.kind").alias("error"), "is_gzip")


_PLAIN = {"WARC-Record-ID": "<urn:a:b>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "text/plain"}


def _kinds(n: Column) -> Column:
    return _by(n, "warcinfo", "conversion", "continuation", "metadata")


def q56_concurrent_to_illegal(spark: SparkSession, sf: str) -> DataFrame:
    h = {**_PLAIN, "WARC-Concurrent-To": "<urn:c:d>"}
    r = build_records(_t(spark, sf, "pages"), _kinds(F.col("page_id")), F.lit(b""), h, keep=("page_id",))
    return r.select("page_id", "record_type", F.size(F.filter("validation", lambda f: f["field"] == "WARC-Concurrent-To")).alias("findings"))


#: Value, whether it is a whole number in base 10, and whether it is one of 64 bits in any notation.
_NUMBERS = (
    ("12", 1, 1), ("-7", 1, 1), ("+3", 1, 1), ("", 0, 0), ("1_000", 0, 1), ("0x1F", 0, 1), ("0x7fffffffffffffff", 0, 1), ("0x8000000000000000", 0, 0), ("-0x8000000000000000", 0, 1),
    ("0b101", 0, 1), ("0o17", 0, 1), ("017", 1, 1), ("09", 1, 0), ("0777777777777777777777", 0, 1), ("01000000000000000000000", 0, 0), ("9223372036854775807", 1, 1), ("9223372036854775808", 0, 0), ("1__0", 0, 0), ("ten", 0, 0), ("1.5", 0, 0),
)


def q57_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *[v for v, _, _ in _NUMBERS]).alias("given"))
    return d.select("event_id", "given", V.is_int(F.col("given")).alias("is_int"), V.is_long(F.col("given")).alias("is_long"))


def q58_blanking(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    more = {"WARC_IP_Address": F.when(p % 2 == 0, F.lit("1.2.3")).otherwise(F.lit("1.2.3.4")), "WARC_Filename": F.lit("a.warc")}
    r = captures(spark, sf, WarcOptions(blank_invalid=True), **more)
    return r.select("page_id", H.get("headers", "WARC-IP-Address").alias("ip"), H.get("headers", "WARC-Filename").alias("file_name"), F.size("validation").alias("findings"))


def q59_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Header lines that end in a bare line feed, each said with its number."""
    text = F.concat(F.lit("WARC/1.1\r\nWARC-Type: metadata\n"), F.when(F.col("page_id") % 2 == 0, "X-A: b\n").otherwise("X-A: b\r\n"), F.lit("Content-Length: 0\r\nno colon\r\nX-Page: "), F.col("page_id").cast("string"), F.lit("\r\n\r\n\r\n\r\n"))
    r = P.frame(_t(spark, sf, "pages").select(F.encode(text, "UTF-8").alias("b")), "b", WarcOptions())
    return r.select(H.get_int64("headers", "X-Page").alias("page_id"), F.explode("before").alias("f")).select("page_id", F.col("f.category").alias("category"), F.col("f.line").alias("line"))


def _info(spark: SparkSession, sf: str, options: WarcOptions) -> DataFrame:
    lines = F.concat(F.lit("software: x\n"), F.when(F.col("page_id") % 3 == 0, "no colon\r\n").otherwise("format: =?utf-8?Q?caf=C3=A9?=\r\n"), F.lit("last: "), F.col("page_id").cast("string"))
    h = {"WARC-Record-ID": "<urn:a:b>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}
    return build_records(_t(spark, sf, "pages"), "warcinfo", F.encode(lines, "UTF-8"), h, options, keep=("page_id",))


def q60_fields_block_findings(spark: SparkSession, sf: str) -> DataFrame:
    r = _info(spark, sf, WarcOptions(block="warn"))
    return r.select("page_id", F.explode("validation").alias("f")).select("page_id", F.col("f.kind").alias("kind"), F.col("f.line").alias("line"))


def q61_fix_fields_block(spark: SparkSession, sf: str) -> DataFrame:
    r = _info(spark, sf, WarcOptions(fix_warc_fields=True, fix_content_length=True))
    return r.select("page_id", F.decode("block", "UTF-8").alias("text"), (F.col("content_length") == F.col("block_size")).alias("length_ok"))


def q62_record_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of records without one: the default is a UUID each, others come from the options."""
    h = {k: v for k, v in _PLAIN.items() if k != "WARC-Record-ID"}
    own = WarcOptions(record_id=lambda: F.lit("urn:own:id"))
    made = [build_records(_t(spark, sf, "pages"), "metadata", F.lit(b""), h, o).select("record_id", F.lit(k).alias("maker")) for k, o in (("default", None), ("own", own))]
    both = made[0].unionByName(made[1])
    return both.groupBy("maker").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"), F.count_if(F.col("record_id").rlike("^urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("uuids"))


_ALGORITHMS = {"SHA1": "sha1", "sha-1": "sha1", "SHA-256": "sha256", "": "sha256", "md5": "md5", "Sha-512": "sha512", "blake2": None, "sha3": None}


def q63_algorithm_names(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *_ALGORITHMS).alias("given"))
    return d.select("event_id", "given", D.parse_field("given")["algorithm"].alias("algorithm"), D.recommended_encoding(D.normalize_algorithm("given")).alias("encoding"))


def q64_merge_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Revisits of a record that is there once, twice and never: a row for each, whatever happens."""
    p = F.col("page_id")
    full = captures(spark, sf)
    twice = full.unionByName(full.where(p % 3 == 1)).where(p % 3 != 2).drop("page_id")
    h = {"WARC-Record-ID": "<urn:r:1>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Refers-To": F.concat(F.lit("<urn:page:"), p.cast("string"), F.lit(">")), "Content-Type": "application/http", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    r = build_records(_t(spark, sf, "pages"), "revisit", F.encode(F.lit("HTTP/1.1 200 OK\r\nA: b\r\n\r\n"), "UTF-8"), h, keep=("page_id",))
    m = R.merge(r, twice)
    return m.select("page_id", "record_type", F.col("error.kind").alias("error"), (F.col("block_size") - F.col("payload_offset")).alias("payload_bytes"))


def q65_policies(spark: SparkSession, sf: str) -> DataFrame:
    """One fault under each policy: findings and errors."""
    out = None
    for name, o in (("ignore", WarcOptions(spec="ignore")), ("warn", WarcOptions()), ("fail", WarcOptions(spec="fail")), ("strict", WarcOptions.strict()), ("none", WarcOptions.no_validation())):
        r = captures(spark, sf, o, WARC_IP_Address=F.when(F.col("page_id") % 2 == 0, F.lit("nowhere")))
        part = r.select("page_id", F.lit(name).alias("policy"), F.size("validation").alias("findings"), F.col("error.kind").alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


def q66_archive_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are written, and read by a stream of the data source that runs to its end."""
    folder, out = scratch(spark, "streamed"), scratch(spark, "stream-out")
    K.write_archives(captures(spark, sf), folder, K.WriterOptions(host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)), writers=3)
    spark.dataSource.register(WarcDataSource)
    stream = spark.readStream.format("warc").load(folder).select(H.get_id("headers", "WARC-Record-ID").alias("record_id"), F.octet_length("block").cast("long").alias("block_bytes"))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("record_id string, block_bytes long").parquet(f"{out}/rows").select(_page(), "block_bytes")


def _to_end(stream: DataFrame, out: str, schema: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is used up; later rows of a key replace earlier ones in mode update."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{out}/rows/part={number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/state").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows/*")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def q67_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events that are closer than six hours; a session is out once the watermark has passed it."""
    s = sessions(_events(spark, sf), "ts", "6 hours", ["user_id"], late="0 seconds")
    return _to_end(s, scratch(spark, "sessions"), "session_start timestamp, session_end timestamp, user_id long, n long").groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"))


def q68_first_captures(spark: SparkSession, sf: str) -> DataFrame:
    """One row of each user and type: all events lie within the watermark."""
    s = first_captures(_events(spark, sf), "ts", ["user_id", "event_type"], late="3650 days").select("user_id", "event_type")
    return _to_end(s, scratch(spark, "first"), "user_id long, event_type string")


def q69_table_function(spark: SparkSession, sf: str) -> DataFrame:
    """SELECT ... LATERAL parse_records(bytes)."""
    register(spark, "parse_records_q69")
    _archive(spark, sf).createOrReplaceTempView("archives_q69")
    return spark.sql("SELECT page_id, p.record_offset, p.is_gzip, p.version, size(p.findings) AS findings, p.headers[0].value AS kind FROM archives_q69, LATERAL parse_records_q69(bytes) p")


def q70_custom_writer(spark: SparkSession, sf: str) -> DataFrame:
    """Own file names, warcinfo fields made from them, and an own form of the records."""
    folder = scratch(spark, "custom")
    o = K.WriterOptions(max_file_size=0, name=lambda serial: f"own-{serial:02d}.warc", warcinfo=lambda name: (("filename", name),), time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC))

    def form() -> tuple[Column, Column]:
        return F.encode(F.concat(F.lit("WARC/"), F.col("version"), F.lit("\r\n"), H.serialize(H.add("headers", "X-Form", "own"))), "UTF-8"), F.col("block")

    K.write_archives(captures(spark, sf), folder, o, writers=2, marshaled=form)
    r = load(spark, folder)
    return r.groupBy(F.element_at(F.split("file_path", "/"), -1).alias("file_name")).agg(F.max(F.get("warc_fields", F.lit(0))["value"]).alias("said"), F.count_if(H.has("headers", "X-Form") == (F.col("record_type") == "warcinfo")).alias("odd"), F.sum(F.size("validation")).alias("findings"))


def q71_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events within each page's window of time, in seconds since the year began."""
    e = _t(spark, sf, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp_ntz").cast("string").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("at"))
    p = _t(spark, sf, "pages").select("page_id", (F.col("page_id") * 7200).alias("begins"), (F.col("page_id") * 7200 + (F.col("page_id") % 3) * 5000).alias("ends"))
    return A.interval_join(e, p, at="at", start="begins", end="ends", bin=3600).select("event_id", "page_id")


def q72_json_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers to JSON and back."""
    j = _multi(spark, sf).withColumn("json", H.to_json("headers"))
    return j.select("page_id", F.get_json_object("json", "$.X-Tag[1]").alias("second"), "json", H.serialize(H.from_json("json")).alias("text"))


def q73_catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    """An index of records as a catalog table, asked by SQL. The table is dropped again, its files stay for the result."""
    name, where = "warc_index_q73", scratch(spark, "catalog")
    index = captures(spark, sf).select("record_id", "record_type", "target_uri", "content_length")
    index.write.parquet(where)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (record_id STRING, record_type STRING, target_uri STRING, content_length BIGINT) USING parquet LOCATION '{where}'")
    try:
        return spark.sql(f"SELECT record_type, count(*) AS n, sum(content_length) AS bytes, count(DISTINCT target_uri) AS uris FROM {name} GROUP BY record_type")
    finally:
        spark.sql(f"DROP TABLE {name}")


#: Header value and what it says.
_ENCODED = (("=?utf-8?B?Y2Fmw6k=?=", "café"), ("=?ISO-8859-1?Q?caf=E9_noir?=", "café noir"), ("a =?utf-8?q?b?= =?utf-8?q?c?= d", "a bc d"), ("plain =x=", "plain =x="), ("=?utf-8?Q?x?= y", "x y"))


def q74_encoded_words(spark: SparkSession, sf: str) -> DataFrame:
    """RFC 2047 words in header values, by the parser of bytes and by the expression."""
    d = _t(spark, sf, "pages").select("page_id", F.concat(F.lit("X-Word: "), _by(F.col("page_id"), *[v for v, _ in _ENCODED]), F.lit("\r\n\r\n")).alias("text"))
    b = d.select("page_id", F.encode(F.concat(F.lit("WARC/1.1\r\n"), "text"), "UTF-8").alias("bytes"))
    strict = P.frame(b, "bytes", WarcOptions(), base="page_id", one=True).select(F.col("record_offset").alias("page_id"), H.get("headers", "X-Word").alias("strict"))
    return d.select("page_id", H.get(H.parse_lenient("text", words=True), "X-Word").alias("lenient")).join(strict, "page_id")


#: Value and whether the URL Standard's parser takes it.
_URLS = (
    ("http://example.org/a b", 1), ("http://", 0), ("http:///path", 1), ("https://u:p@h.org:8080/?q#f", 1), ("http://h.org:99999/", 0), ("http://h.org:x/", 0), ("http://256.1.1.1/", 0), ("http://0x7f.1/", 1),
    ("http://[::1]:80/", 1), ("http://[::1/", 0), ("http://a<b/", 0), ("urn:uuid:1-2", 1), ("dns:example.org", 1), ("example.org/x", 0), ("", 0), ("http://ex%41mple.org/", 1), ("http://a%2Fb/", 0), ("http://u@/", 0),
    ("foo://", 1), ("foo://a b/", 0), ("file:///tmp/x", 1), ("http:\\\\h.org\\x", 1), ("1http://h/", 0), ("  http://h.org/  ", 1), ("http://1.2.3.4.5/", 0), ("http://1.2.3/", 1), ("mailto:a@b", 1), ("ftp://h:21/", 1),
)


def q75_urls(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "events").select("event_id", _by(F.col("event_id"), *[u for u, _ in _URLS]).alias("given"))
    return d.select("event_id", "given", V.is_uri(F.col("given")).alias("ok"))


#: Name and its spelling, known or not.
_SPELLED = (("warc-TYPE", "WARC-Type"), ("x-foo-BAR", "X-Foo-Bar"), ("foo bar-baz", "foo bar-baz"), ("a--b", "A--B"), ("x_y-z", "X_y-Z"), ("(odd)-name", "(odd)-name"))


def q76_names_in_both_parsers(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "pages").select("page_id", F.concat(_by(F.col("page_id"), *[n for n, _ in _SPELLED]), F.lit(": v\r\n\r\n")).alias("text"))
    b = d.select("page_id", F.encode(F.concat(F.lit("WARC/1.1\r\n"), "text"), "UTF-8").alias("bytes"))
    strict = P.frame(b, "bytes", WarcOptions(), base="page_id", one=True).select(F.col("record_offset").alias("page_id"), F.get("headers", F.lit(0))["name"].alias("strict"))
    return d.select("page_id", F.get(H.parse_lenient("text"), F.lit(0))["name"].alias("lenient")).join(strict, "page_id")


def q77_index_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A file cut at record starts by an index of its records, read in ranges."""
    folder, _ = _in_order(spark, sf, "indexed")
    index = scratch(spark, "index")
    A.index(load(spark, folder, split_bytes=RANGE)).write.parquet(index)
    return load(spark, folder, index=index, rangeBytes="65536").select(_page(), "record_type", "content_length")


def _written(spark: SparkSession, sf: str, name: str, writers: int = 4) -> str:
    """Captures in files that are as large as their writers' shares."""
    folder = scratch(spark, name)
    K.write_archives(captures(spark, sf), folder, K.WriterOptions(max_file_size=0, host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)), writers=writers)
    return folder


def q78_split_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed files cut into ranges without an index: each record once."""
    r = load(spark, _written(spark, sf, "split"), split_bytes=65536)
    return r.select(_page(), "record_type", "content_length", F.size("validation").alias("findings"), F.col("error.kind").alias("error"))


def q79_large_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of which rows hold 512 bytes: size and digest of the whole, and all of it in chunks."""
    r = load(spark, _written(spark, sf, "large"), WarcOptions(max_block_bytes=512)).select(_page(), "file_path", "record_offset", "block_size", "block_digest", F.size("validation").alias("findings"))
    c = block_chunks(r, 1000).groupBy("file_path", "record_offset").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("data")).alias("chunk_bytes"))
    return r.join(c, ["file_path", "record_offset"]).drop("file_path", "record_offset")


def q80_stream_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that stream into archives, and back."""
    spark.dataSource.register(WarcDataSource)
    folder, state = scratch(spark, "sink"), scratch(spark, "sink-state")
    schema = spark.read.parquet(f"{sf}/pages.parquet").schema
    made = captures_of(spark.readStream.schema(schema).parquet(f"{sf}/pages.parquet*")).select("version", "headers", "block")
    made.writeStream.format("warc").option("path", folder).option("host", "example").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return load(spark, folder).select(_page(), "block_size", F.size("validation").alias("findings"))


def q81_write_format(spark: SparkSession, sf: str) -> DataFrame:
    """df.write.format("warc"), each record synced, files rolled by size."""
    spark.dataSource.register(WarcDataSource)
    folder = scratch(spark, "format")
    w = captures(spark, sf).select("version", "headers", "block").write.format("warc").mode("append")
    w.option("path", folder).option("prefix", "p-").option("host", "example").option("flush", "true").option("maxFileSize", str(1 << 20)).save()
    return load(spark, f"{folder}/p-*.gz").select(_page(), "block_size", F.size("validation").alias("findings"))


def q82_long_values(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts, paths and numbers of ten thousand letters, made from the pages' own."""
    p, n = _t(spark, sf, "pages"), 10_000
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    values = {"path": F.concat("url", F.lit("/"), F.repeat(F.lit("a%41"), n)), "host": F.concat(F.lit("http://"), F.repeat(F.concat(host, F.lit(".")), n // 10), host), "no_host": F.concat(F.lit("http://"), F.repeat(F.lit("a"), n), F.lit("|"), host), "blanks": F.concat("url", F.repeat(F.lit(" "), n), F.lit("x"), F.repeat(F.lit(" "), n))}
    numbers = {"zeros": F.concat(F.repeat(F.lit("0"), n), F.col("page_id") % 8), "digits": F.concat(F.col("page_id") + 1, F.repeat(F.lit("9"), n)), "hexadecimal": F.concat(F.lit("0x"), F.repeat(F.lit("_0"), n), F.hex("page_id"))}
    return p.select("page_id", *[V.is_uri(v).alias(k) for k, v in values.items()], *[V.is_long(v).alias(k) for k, v in numbers.items()])


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each page in three segments; by page_id modulo 5 the second is missing, or there twice, the total length is wrong, or not
    said, or all is well."""
    fault = F.col("page_id") % 5
    numbers = F.when(fault == 0, F.array(*map(F.lit, (1, 3)))).when(fault == 1, F.array(*map(F.lit, (1, 2, 2, 3)))).otherwise(F.array(*map(F.lit, (1, 2, 3))))
    d = _t(spark, sf, "pages").select("page_id", "html", F.ceil(F.length("html") / 3).cast("int").alias("w"), F.explode(numbers).alias("i"))
    part = F.substring("html", (F.col("i") - 1) * F.col("w") + 1, F.when(F.col("i") == 3, F.length("html")).otherwise(F.col("w")))
    origin = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    total = F.octet_length("html") + F.when(fault == 2, 1).otherwise(0)
    h = {"WARC-Record-ID": F.when(F.col("i") == 1, origin).otherwise(F.concat(F.lit("<urn:part:"), F.col("page_id").cast("string"), F.lit(":"), F.col("i").cast("string"), F.lit(">"))), "WARC-Segment-Origin-ID": F.when(F.col("i") > 1, origin), "WARC-Segment-Number": F.col("i").cast("string"), "WARC-Segment-Total-Length": F.when((F.col("i") == 3) & (fault != 3), total.cast("string")), "WARC-Payload-Digest": F.when(F.col("i") == 1, D.digest_field(F.encode("html", "UTF-8"), "sha1", "base16"))}
    return build_records(d, F.when(F.col("i") == 1, F.lit("resource")).otherwise(F.lit("continuation")), F.encode(part, "UTF-8"), h)


def q83_segment_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that are missing or repeated, and total lengths that are wrong or not said."""
    f = A.segment_findings(_segments(spark, sf))
    return f.select(F.regexp_extract("origin_id", r"(\d+)$", 1).cast("long").alias("page_id"), "kind", "first", "last")


def q84_segment_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of all segments of a record, one after the other, beside what its first one says."""
    d = A.segment_digests(_segments(spark, sf))
    return d.select(F.regexp_extract("origin_id", r"(\d+)$", 1).cast("long").alias("page_id"), "segments", "size", (F.concat(F.lit("sha1:"), "digest") == F.col("said")).alias("same"))


def q85_nearest_captures(spark: SparkSession, sf: str) -> DataFrame:
    """For each page the capture of its host that is nearest to seven seconds after its own, on either side, read from its place."""
    folder = _written(spark, sf, "captured")
    index = captures_index.write_index(load(spark, folder, split_bytes=RANGE), scratch(spark, "capture-index"), key=captures_index.host_key("target_uri"))
    asks = _t(spark, sf, "pages").select("page_id", captures_index.host_key("url").alias("key"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") + 7).alias("time"))
    found = captures_index.nearest(asks, index).select("page_id", "capture.file_path", "capture.record_offset", F.regexp_extract("capture.record_id", r"(\d+)$", 1).cast("long").alias("nearest"))
    # written once, as it is needed twice
    found.write.parquet(places := scratch(spark, "nearest"))
    found = spark.read.schema(found.schema).parquet(places)
    read = captures_index.read_at(spark, found.select("file_path", "record_offset").distinct()).select(F.col("file_path").alias("_f"), F.col("record_offset").alias("_o"), "content_length")
    return found.join(read, (F.col("file_path") == F.col("_f")) & (F.col("record_offset") == F.col("_o")), "left").select("page_id", "nearest", "content_length")


def q86_nanoseconds(spark: SparkSession, sf: str) -> DataFrame:
    """Times with nine digits, written and read."""
    n = F.lit(1704067200000000000).cast("long") + F.col("event_id") * 250000010
    h = H.add_time_nano(H.fields([]), "WARC-Date", n)
    return _t(spark, sf, "events").select("event_id", H.get(h, "WARC-Date").alias("text"), (H.nanos_of(H.get(h, "WARC-Date")) - n).alias("off"))


def q87_revisits_across_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that arrive in two parts, as archives: repeats are revisits of a capture that any earlier batch brought."""
    spark.dataSource.register(WarcDataSource)
    folder, state, out, made = (scratch(spark, name) for name in ("arriving", "first-state", "deduplicated", "documents"))
    _documents(spark, sf).select("doc_id", "version", "headers", "block").write.parquet(made)
    low, high = spark.read.parquet(made).agg(F.min("doc_id"), F.max("doc_id")).first()
    half = F.lit(((low or 0) + (high or 0)) // 2)
    for k, part in enumerate((F.col("doc_id") <= half, F.col("doc_id") > half)):
        K.write_archives(spark.read.parquet(made).where(part), folder, K.WriterOptions(max_file_size=0, prefix=f"{k}-", host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)), order=("doc_id",))
        stream = P.typed(spark.readStream.format("warc").load(folder), WarcOptions())
        deduplicate_stream(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), state, trigger={"availableNow": True}).awaitTermination()
    r = spark.read.parquet(out)
    return r.select(F.regexp_extract(H.get_id("headers", "WARC-Record-ID"), r"(\d+)$", 1).cast("long").alias("doc_id"), "record_type", R.revisit_ref()["target_record_id"].alias("refers_to"), (F.col("block_size") == F.col("payload_offset")).alias("no_payload"))


def q88_files_of_eight_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Where pages go that eight writers write at once, each rolling its files by size."""
    d = _t(spark, sf, "pages").select("page_id", F.octet_length("html").alias("n"))
    out = K.plan_files(d, order=("page_id",), max_file_size=65536, size=F.col("n"), estimated=F.col("n"), writers=8, writer=F.col("page_id"))
    return out.select("page_id", "writer", "file_number", "file_offset")


def q89_balanced_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as records of their hosts, a host's in one file, hosts dealt to four writers by bytes, and read back from their places."""
    folder, n = scratch(spark, "balanced"), 4
    host = F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(""))
    r = build_records(_t(spark, sf, "pages").withColumn("host", host), "response", _body(), _headers(), keep=("page_id", "host"))
    m = K.write_archives(r, folder, K.WriterOptions(max_file_size=0, host="example", time=datetime(2001, 9, 12, 5, 30, 20, tzinfo=UTC)), writers=n, group="host", order=("page_id",), balanced=True)
    at = load(spark, folder).select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.col("record_offset").alias("file_offset"), _page(), F.regexp_extract(H.get("headers", "WARC-Target-URI"), "://([^/?#]*)", 1).alias("host"), "block_size")
    one = at.groupBy("host").agg((F.count_distinct("file_name") == 1).alias("one_file"))
    return m.join(at, ["file_name", "file_offset"]).join(one, "host").select("page_id", "block_size", "one_file")


_HEAD = "(CASE page_id % 4 WHEN 0 THEN '200 OK' WHEN 1 THEN '301 Moved Permanently' WHEN 2 THEN '404 Not Found' ELSE '500 Internal Server Error' END)"
_HTTP = f"(strlen('HTTP/1.1 ') + strlen({_HEAD}) + 2 + strlen('Content-Type: text/html; charset=utf-8') + 2 + strlen('Content-Length: ') + strlen(CAST(strlen(html) AS VARCHAR)) + 4)"
_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '')"
_B32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, 1 + 5 * i + k, 1) AS INT) * CAST(pow(2, 4 - k) AS INT))) AS BIGINT), 1)), 'string_agg', '')"""


def _pick(n: str, values: object) -> str:
    rows = list(values)
    return f"(CASE {n} % {len(rows)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(rows)) + " END)"


def _quoted(values: object) -> list[str]:
    return ["'" + str(v).replace("'", "''") + "'" for v in values]


_FIRST = "(SELECT *, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)"

ORACLE_SQL = {
    "q01_roundtrip_status_counts": f"SELECT 'response' AS record_type, CAST(substr({_HEAD}, 1, 3) AS INT) AS status_code, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS payload_bytes FROM pages GROUP BY ALL",
    "q02_content_length": f"SELECT page_id, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length, CAST({_HTTP} + strlen(html) AS BIGINT) AS block_size, CAST({_HTTP} AS BIGINT) AS head_bytes FROM pages",
    "q03_block_digest_sha256": "SELECT page_id, sha256(html) AS digest FROM pages",
    "q04_digest_sha1_base32": f"WITH b AS (SELECT page_id, (unhex(sha1(html))::BIT)::VARCHAR AS bits FROM pages) SELECT page_id, {_B32} AS digest FROM b",
    "q05_digest_md5_base64": "SELECT page_id, to_base64(unhex(md5(html))) AS digest FROM pages",
    "q06_digest_validate": f"""WITH b AS (SELECT page_id, (unhex(sha1(html))::BIT)::VARCHAR AS bits, page_id % 5 = 0 AS bad FROM pages)
        SELECT page_id, CAST(bad AS INT) AS findings, CASE WHEN bad THEN 'WARC-Payload-Digest' END AS field, CASE WHEN bad THEN 'sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA' END AS expected, CASE WHEN bad THEN 'sha1:' || {_B32} END AS actual FROM b""",
    "q07_detect_encoding": f"SELECT doc_id, {_pick('doc_id', _quoted(a for a, _ in _CODED))} AS algorithm, {_pick('doc_id', _quoted(('base16', 'base32', 'base64', 'base16', 'base32', 'base64', 'base16', 'base32', 'base64', 'base16')))} AS encoding FROM documents",
    "q08_header_get": "SELECT page_id, url AS uri, page_id % 2 = 0 AS has_type, page_id || '|b' || page_id AS tags, CAST(page_id AS INT) AS tag, CAST(NULL AS BIGINT) AS no_int FROM pages",
    "q09_header_set_delete": r"""SELECT page_id, 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'X-Tag: new' || chr(13) || chr(10) || 'Last: z' || chr(13) || chr(10) || 'Content-Length: ' || page_id || chr(13) || chr(10)
        || 'WARC-Refers-To: <urn:' || page_id || '>' || chr(13) || chr(10) AS text FROM pages""",
    "q10_header_sort": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Content-Type=text/html;' ELSE '' END || 'WARC-Target-URI=' || url || ';X-Tag=' || page_id || ';X-Tag=b' || page_id AS text FROM pages",
    "q11_normalize_names": f"SELECT event_id, {_pick('event_id', _quoted(_NAMES))} AS given, {_pick('event_id', _quoted(_NAMES.values()))} AS name FROM events",
    "q12_record_types": "SELECT event_id, CASE event_type WHEN 'view' THEN 2 WHEN 'signup' THEN 8 WHEN 'click' THEN 32 ELSE 0 END AS code, CASE event_type WHEN 'view' THEN 'response' WHEN 'signup' THEN 'request' WHEN 'click' THEN 'revisit' END AS record_type, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS findings FROM events",
    "q13_required_fields": """SELECT 'missing' AS kind, field, count(*) AS n FROM (SELECT 'WARC-Record-ID' AS field FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'WARC-Date' FROM pages WHERE page_id % 4 = 0
        UNION ALL SELECT 'Content-Type' FROM pages WHERE page_id % 5 = 0 AND strlen(html) > 0) GROUP BY ALL""",
    "q14_illegal_fields": "SELECT page_id, 'field' AS kind, 'WARC-Filename' AS field FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'field', 'WARC-Profile' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'field', 'WARC-Segment-Origin-ID' FROM pages WHERE page_id % 5 = 0",
    "q15_duplicate_fields": "SELECT page_id, 'repeated' AS kind, 'WARC-Truncated' AS field FROM pages, range(2) WHERE page_id % 2 = 0",
    "q16_date_validation": f"""WITH e AS (SELECT event_id, {_pick('event_id', _quoted(_DATES))} AS given FROM events)
        SELECT event_id, event_id % 6 IN (0, 3, 4) AS ok, CASE event_id % 6 WHEN 0 THEN '2024-02-29 12:00:00' WHEN 3 THEN '2024-01-01 08:00:00' WHEN 4 THEN '2024-01-01 10:00:00' END AS utc FROM e""",
    "q17_id_validation": f"""WITH e AS (SELECT event_id, {_pick('event_id', _quoted(_IDS))} AS given FROM events)
        SELECT event_id, regexp_matches(given, '^<[^<>]+>$') AND regexp_matches(trim(given, '<>'), '^[A-Za-z][A-Za-z0-9+.-]*:[^<>]+$') AS ok, trim(given, '<>') AS bare,
        CASE WHEN starts_with(given, '<') OR ends_with(given, '>') THEN given ELSE '<' || given || '>' END AS bracketed FROM e""",
    "q18_ip_validation": f"SELECT event_id, {_pick('event_id', _quoted(_IPS))} AS given, event_id % 8 IN (0, 3, 4, 6) AS ok FROM events",
    "q19_uri_host": f"SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^ <>]+$') AS ok, {_HOST} AS host FROM pages",
    "q20_fix_content_length": f"SELECT page_id, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS findings FROM pages",
    "q21_fix_digest": f"""WITH b AS (SELECT page_id, html, (unhex(sha1(html))::BIT)::VARCHAR AS bits FROM pages)
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'sha1:' || {_B32} WHEN 1 THEN 'MD5:' || upper(md5(html)) ELSE 'sha256:' || sha256(html) END AS digest, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS findings FROM b""",
    "q22_fix_http_separator": """SELECT page_id, CAST(29 + strlen(CAST(page_id AS VARCHAR)) AS BIGINT) AS content_length, CAST(29 + strlen(CAST(page_id AS VARCHAR)) AS BIGINT) AS block_size,
        CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS findings, CAST(page_id AS VARCHAR) AS page FROM pages""",
    "q23_folded_header_parse": """WITH t AS (SELECT page_id, 'WARC-Type: metadata' || chr(13) || chr(10) || 'X-Page: a b' || page_id || ' c' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) AS text FROM pages)
        SELECT page_id, text AS lenient, text AS strict FROM t""",
    "q24_http_status": f"SELECT page_id, {_HEAD} AS status_line, CAST(substr({_HEAD}, 1, 3) AS INT) AS status_code, 'text/html; charset=utf-8' AS content_type FROM pages",
    "q25_http_request_uri": "SELECT page_id, 'http_request' AS block_kind, url AS request_uri FROM pages",
    "q26_payload_split": f"SELECT page_id, CAST({_HTTP} AS BIGINT) AS payload_offset, md5(html) AS payload_md5 FROM pages",
    "q27_warc_fields_block": "SELECT p_partkey, 'Name' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'Brand', p_brand FROM part UNION ALL SELECT p_partkey, 'Size', CAST(p_size AS VARCHAR) FROM part",
    "q28_record_offsets": "SELECT page_id, CAST(page_id // 50 AS BIGINT) AS file, strlen(html) AS n, CAST(coalesce(sum(strlen(html)) OVER (PARTITION BY page_id // 50 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM pages",
    "q29_gzip_members": "SELECT CAST(page_id // 20 AS BIGINT) AS g, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS payload_bytes, CAST(0 AS BIGINT) AS findings, count(*) AS members FROM pages GROUP BY 1",
    "q31_to_revisit": f"SELECT doc_id, CASE WHEN doc_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN doc_id <> first THEN 'urn:page:' || first END AS refers_to, doc_id <> first OR strlen(text) = 0 AS no_payload FROM {_FIRST}",
    "q87_revisits_across_batches": f"SELECT doc_id, CASE WHEN doc_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN doc_id <> first THEN 'urn:page:' || first END AS refers_to, doc_id <> first OR strlen(text) = 0 AS no_payload FROM {_FIRST}",
    "q32_merge_revisits": f"SELECT doc_id, 'response' AS record_type, md5(text) AS payload_md5, CAST(NULL AS VARCHAR) AS error, true AS length_ok FROM {_FIRST} WHERE doc_id <> first",
    "q33_dangling_revisits": "SELECT doc_id FROM labels WHERE doc_id % 4 = 0",
    "q34_referenced_records": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.doc_id % 4 <> 0)",
    "q35_rolling_files": """WITH RECURSIVE p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS rn, strlen(html) AS n FROM pages),
        w AS (SELECT rn, page_id, CAST(1 AS BIGINT) AS f, CAST(0 AS BIGINT) AS o, CAST(n AS BIGINT) AS s FROM p WHERE rn = 1
        UNION ALL SELECT p.rn, p.page_id, CASE WHEN w.s > 0 AND w.s + p.n > 65536 THEN w.f + 1 ELSE w.f END, CASE WHEN w.s > 0 AND w.s + p.n > 65536 THEN 0 ELSE w.s END, CASE WHEN w.s > 0 AND w.s + p.n > 65536 THEN p.n ELSE w.s + p.n END FROM w JOIN p ON p.rn = w.rn + 1)
        SELECT page_id, f AS file_number, o AS file_offset FROM w""",
    "q88_files_of_eight_writers": """WITH RECURSIVE p AS (SELECT page_id, page_id % 8 AS k, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) AS rn, strlen(html) AS n FROM pages),
        w AS (SELECT k, rn, page_id, CAST(1 AS BIGINT) AS f, CAST(0 AS BIGINT) AS o, CAST(n AS BIGINT) AS s FROM p WHERE rn = 1
        UNION ALL SELECT p.k, p.rn, p.page_id, CASE WHEN w.s > 0 AND w.s + p.n > 65536 THEN w.f + 1 ELSE w.f END, CASE WHEN w.s > 0 AND w.s + p.n > 65536 THEN 0 ELSE w.s END, CASE WHEN w.s > 0 AND w.s + p.n > 65536 THEN p.n ELSE w.s + p.n END FROM w JOIN p ON p.k = w.k AND p.rn = w.rn + 1)
        SELECT page_id, CAST(k AS INT) AS writer, f AS file_number, o AS file_offset FROM w""",
    "q89_balanced_writers": f"SELECT page_id, CAST({_HTTP} + strlen(html) AS BIGINT) AS block_size, true AS one_file FROM pages",
    "q36_concurrent_to": """WITH i AS (SELECT conv_id, turn, '<urn:c:' || conv_id || ':' || turn || '>' AS id FROM conversations)
        SELECT a.conv_id, a.turn, coalesce(string_agg(b.id, ' ' ORDER BY b.id), '') AS others FROM i a LEFT JOIN i b ON a.conv_id = b.conv_id AND a.id <> b.id GROUP BY a.conv_id, a.turn, a.id""",
    "q37_warcinfo_per_file": "SELECT 'q-20010912053020-000' || n || '-example.warc.gz' AS file_name, CAST(1 AS BIGINT) AS infos, CAST(0 AS BIGINT) AS odd, CAST(0 AS BIGINT) AS findings FROM (VALUES (1), (2)) t(n)",
    "q38_file_names": "SELECT event_id, 'foo-' || strftime(TIMESTAMP '2024-01-01' + to_seconds(event_id), '%Y%m%d%H%M%S') || '-' || lpad(CAST(event_id + 1 AS VARCHAR), CAST(greatest(4, strlen(CAST(event_id + 1 AS VARCHAR))) AS INT), '0') || '-example.warc' AS file_name FROM events",
    "q39_as_of_capture": "SELECT e.event_id, p.page_id FROM (SELECT event_id, ts, event_id % 10 AS k FROM events) e ASOF LEFT JOIN (SELECT page_id, page_id % 10 AS k, TIMESTAMP '2024-01-01' + to_seconds(page_id * 3600) AS at FROM pages) p ON e.k = p.k AND e.ts >= p.at",
    "q40_host_rollup": f"SELECT host, status, count(*) AS pages, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT {_HOST} AS host, {_HEAD} AS status, strlen(html) AS n FROM pages) GROUP BY ROLLUP (host, status)",
    "q41_cube": "SELECT lang, long_text, count(*) AS n FROM (SELECT lang, n_chars > 2000 AS long_text FROM documents) GROUP BY CUBE (lang, long_text)",
    "q42_top_hosts": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10",
    "q43_set_operations": "SELECT doc_id, 'unlabelled' AS part FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)",
    "q44_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q45_bit_mask_filter": "SELECT CASE event_type WHEN 'view' THEN 2 ELSE 32 END AS record_type_code, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
    "q46_join_segments": "SELECT page_id, 3 AS segments, md5(html) AS md5 FROM pages",
    "q48_headers_only": f"SELECT page_id, 'response' AS record_type, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%d %H:%M:%S') AS warc_date, url AS target_uri FROM pages",
    "q49_start_offset": f"SELECT page_id, 'response' AS record_type, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length FROM (SELECT *, row_number() OVER (ORDER BY page_id) AS rn FROM pages) WHERE rn > 2",
    "q50_first_record": "SELECT page_id, CAST(0 AS BIGINT) AS record_offset, true AS size_ok, 0 AS findings FROM pages",
    "q51_groups_stay_together": "SELECT conv_id, CAST(1 AS BIGINT) AS files, count(*) AS turns, true AS in_order FROM conversations GROUP BY conv_id",
    "q52_rotation": "SELECT p || '-20010912053020-0001-example.warc.gz' AS file_name, (SELECT count(*) FROM pages) AS records, CAST(0 AS BIGINT) AS first FROM (VALUES ('a'), ('b')) t(p)",
    "q53_add_times": "SELECT event_id, strftime(TIMESTAMP '2024-01-01' + to_seconds(event_id // 4), '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(TIMESTAMP '2024-01-01' + to_seconds(event_id // 4), '%Y-%m-%dT%H:%M:%S') || (CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END) || 'Z' AS fraction FROM events",
    "q54_versions": f"SELECT page_id, {_pick('page_id', _quoted(_VERSIONS))} AS version, {_pick('page_id', (1, 1, 0, 0))} AS version_major, {_pick('page_id', (0, 1, 0, 0))} AS version_minor, {_pick('page_id', (0, 0, 1, 1))} AS findings FROM pages",
    "q55_broken_gzip": "SELECT page_id, 'gzip' AS error, true AS is_gzip FROM pages",
    "q56_concurrent_to_illegal": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'warcinfo' WHEN 1 THEN 'conversion' WHEN 2 THEN 'continuation' ELSE 'metadata' END AS record_type, CASE WHEN page_id % 4 = 3 THEN 0 ELSE 2 END AS findings FROM pages",
    "q57_numbers": f"SELECT event_id, {_pick('event_id', _quoted(v for v, _, _ in _NUMBERS))} AS given, {_pick('event_id', [b for _, b, _ in _NUMBERS])} = 1 AS is_int, {_pick('event_id', [b for _, _, b in _NUMBERS])} = 1 AS is_long FROM events",
    "q58_blanking": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE '1.2.3.4' END AS ip, '' AS file_name, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS findings FROM pages",
    "q59_line_ends": "SELECT page_id, 'syntax' AS category, line FROM pages, (VALUES (2), (3), (5)) t(line) WHERE line <> 3 OR page_id % 2 = 0",
    "q60_fields_block_findings": "SELECT page_id, 'warc_fields' AS kind, line FROM pages, (VALUES (1), (2), (3)) t(line) WHERE line <> 2 OR page_id % 3 = 0",
    "q61_fix_fields_block": "SELECT page_id, 'Software: x' || chr(13) || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Format: café' || chr(13) || chr(10) END || 'Last: ' || page_id || chr(13) || chr(10) AS text, true AS length_ok FROM pages",
    "q62_record_ids": "SELECT maker, count(*) AS n, CASE maker WHEN 'own' THEN 1 ELSE count(*) END AS ids, CASE maker WHEN 'own' THEN 0 ELSE count(*) END AS uuids FROM pages, (VALUES ('default'), ('own')) t(maker) GROUP BY maker",
    "q63_algorithm_names": f"SELECT event_id, {_pick('event_id', _quoted(_ALGORITHMS))} AS given, {_pick('event_id', ['NULL' if v is None else repr(v) for v in _ALGORITHMS.values()])} AS algorithm, CASE WHEN event_id % 8 < 2 THEN 'base32' ELSE 'base16' END AS encoding FROM events",
    "q64_merge_errors": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id % 3 > 0 THEN 'merge' END AS error, CAST(CASE WHEN page_id % 3 = 0 THEN strlen(html) ELSE 0 END AS BIGINT) AS payload_bytes FROM pages",
    "q65_policies": "SELECT page_id, policy, CASE WHEN page_id % 2 = 0 AND policy IN ('warn', 'fail', 'strict') THEN 1 ELSE 0 END AS findings, CASE WHEN page_id % 2 = 0 AND policy IN ('fail', 'strict') THEN 'spec' END AS error FROM pages, (VALUES ('ignore'), ('warn'), ('fail'), ('strict'), ('none')) t(policy)",
    "q66_archive_stream": f"SELECT page_id, CAST({_HTTP} + strlen(html) AS BIGINT) AS block_bytes FROM pages",
    "q68_first_captures": "SELECT DISTINCT user_id, event_type FROM events",
    "q69_table_function": "SELECT page_id, CAST(0 AS BIGINT) AS record_offset, true AS is_gzip, '1.1' AS version, 0 AS findings, 'response' AS kind FROM pages",
    "q70_custom_writer": "SELECT 'own-0' || n || '.warc.gz' AS file_name, 'own-0' || n || '.warc.gz' AS said, CAST(0 AS BIGINT) AS odd, CAST(0 AS BIGINT) AS findings FROM (VALUES (1), (2)) t(n)",
    "q71_interval_join": "SELECT event_id, page_id FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS second FROM events) JOIN pages ON second >= page_id * 7200 AND second < page_id * 7200 + (page_id % 3) * 5000",
    "q72_json_headers": r"""SELECT page_id, 'b' || page_id AS second, '{"WARC-Target-URI":["' || url || '"],"X-Tag":["' || page_id || '","b' || page_id || '"]' || CASE WHEN page_id % 2 = 0 THEN ',"Content-Type":["text/html"]' ELSE '' END || '}' AS json,
        'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'X-Tag: ' || page_id || chr(13) || chr(10) || 'X-Tag: b' || page_id || chr(13) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'Content-Type: text/html' || chr(13) || chr(10) ELSE '' END AS text FROM pages""",
    "q73_catalog_table": f"SELECT 'response' AS record_type, count(*) AS n, CAST(sum({_HTTP} + strlen(html)) AS BIGINT) AS bytes, count(DISTINCT url) AS uris FROM pages",
    "q74_encoded_words": f"SELECT page_id, {_pick('page_id', _quoted(v for _, v in _ENCODED))} AS lenient, {_pick('page_id', _quoted(v for _, v in _ENCODED))} AS strict FROM pages",
    "q75_urls": f"SELECT event_id, {_pick('event_id', _quoted(u for u, _ in _URLS))} AS given, {_pick('event_id', [b for _, b in _URLS])} = 1 AS ok FROM events",
    "q76_names_in_both_parsers": f"SELECT page_id, {_pick('page_id', _quoted(v for _, v in _SPELLED))} AS lenient, {_pick('page_id', _quoted(v for _, v in _SPELLED))} AS strict FROM pages",
    "q77_index_ranges": f"SELECT page_id, 'response' AS record_type, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length FROM pages",
    "q78_split_archives": f"SELECT page_id, 'response' AS record_type, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length, 0 AS findings, CAST(NULL AS VARCHAR) AS error FROM pages",
    "q79_large_blocks": f"""SELECT page_id, CAST(strlen(b) AS BIGINT) AS block_size, 'sha256:' || sha256(b) AS block_digest, 0 AS findings, CAST(ceil(strlen(b) / 1000.0) AS BIGINT) AS chunks, CAST(strlen(b) AS BIGINT) AS chunk_bytes
        FROM (SELECT page_id, 'HTTP/1.1 ' || {_HEAD} || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS b FROM pages)""",
    "q80_stream_sink": f"SELECT page_id, CAST({_HTTP} + strlen(html) AS BIGINT) AS block_size, 0 AS findings FROM pages",
    "q81_write_format": f"SELECT page_id, CAST({_HTTP} + strlen(html) AS BIGINT) AS block_size, 0 AS findings FROM pages",
    "q82_long_values": "SELECT page_id, true AS path, true AS host, false AS no_host, true AS blanks, true AS zeros, false AS digits, true AS hexadecimal FROM pages",
    "q83_segment_findings": """SELECT page_id, kind, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last FROM (
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'repeated' WHEN 2 THEN 'total_length' ELSE 'no_total' END AS kind,
               CASE page_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN strlen(html) + 1 END AS a, CASE page_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE strlen(html) END AS b FROM pages WHERE page_id % 5 <> 4)""",
    "q84_segment_digests": """WITH p AS (SELECT page_id, html, CAST(ceil(length(html) / 3.0) AS BIGINT) AS w FROM pages)
        SELECT page_id, CAST(CASE page_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 3 END AS BIGINT) AS segments,
               CAST(strlen(html) + CASE page_id % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END * strlen(substr(html, w + 1, w)) AS BIGINT) AS size, page_id % 5 > 1 AS same FROM p""",
    "q85_nearest_captures": f"""WITH c AS (SELECT page_id, coalesce({_HOST}, '') AS h, page_id AS tm, CAST({_HTTP} + strlen(html) AS BIGINT) AS content_length FROM pages),
        a AS (SELECT page_id, h, tm + 7 AS t FROM c), b AS (SELECT a.*, c.page_id AS p1, c.tm AS t1, c.content_length AS l1 FROM a ASOF LEFT JOIN c ON a.h = c.h AND a.t >= c.tm),
        n AS (SELECT b.*, c.page_id AS p2, c.tm AS t2, c.content_length AS l2 FROM b ASOF LEFT JOIN c ON b.h = c.h AND b.t <= c.tm)
        SELECT page_id, CASE WHEN p2 IS NULL OR t - t1 <= t2 - t THEN p1 ELSE p2 END AS nearest, CASE WHEN p2 IS NULL OR t - t1 <= t2 - t THEN l1 ELSE l2 END AS content_length FROM n""",
    "q86_nanoseconds": """SELECT event_id, strftime(TIMESTAMP '2024-01-01' + to_seconds((event_id * 250000010) // 1000000000), '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN (event_id * 250000010) % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST((event_id * 250000010) % 1000000000 AS VARCHAR), 9, '0'), '0') END || 'Z' AS text, CAST(0 AS BIGINT) AS off FROM events""",
    "q67_sessions": """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS new FROM events),
        s AS (SELECT user_id, ts, sum(CASE WHEN coalesce(new, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e),
        g AS (SELECT user_id, k, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS ends FROM s GROUP BY 1, 2)
        SELECT user_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS sessions FROM g WHERE ends <= (SELECT max(ts) FROM events) GROUP BY user_id""",
    "q30_resync_after_garbage": """SELECT page_id, 'response' AS record_type, page_id % 7 AS skipped_bytes, page_id % 7 AS record_offset, CASE WHEN page_id % 7 > 0 THEN 1 ELSE 0 END AS findings, CAST(NULL AS VARCHAR) AS error FROM pages
        UNION ALL SELECT page_id, NULL, 12, page_id % 7 + l + 12, 0, 'no_record' FROM (SELECT page_id, 8 + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Record-ID: <urn:page:>') + strlen(CAST(page_id AS VARCHAR)) + 2 + strlen('WARC-Date: 2024-01-01T00:00:00Z') + 2
        + strlen('WARC-Target-URI: ') + strlen(url) + 2 + strlen('Content-Type: application/http; msgtype=response') + 2 + strlen('Content-Length: ') + strlen(CAST(""" + f"{_HTTP} + strlen(html)" + """ AS VARCHAR)) + 4 + """ + f"{_HTTP} + strlen(html)" + """ + 4 AS l FROM pages)""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
QUERIES |= {"q03_block_digest_sha256": _digests("sha256", "base16"), "q04_digest_sha1_base32": _digests("sha1", "base32"), "q05_digest_md5_base64": _digests("md5", "base64")}
QUERIES = dict(sorted(QUERIES.items()))
