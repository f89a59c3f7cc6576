"""Content-addressed WARC archive: payload bytes once, exact record headers apart.

An archive is a folder with two tables. `payloads` has each distinct payload once, under its
address (SHA-256, SHA-1 and length, which all must agree). `headers` has for each record the
exact bytes before the payload, that is the WARC header and the HTTP header, and the address.
A record is its header, its payload (none for a revisit) and the end mark, put together by a
join on the address. Whatever is read from `payloads` is hashed again; `verified` tells
whether it still is what its address and the record's header say.

Of records with equal payloads of at least `min_bytes`, that with the largest id is a
response and the others revisit it.

Scale: the payload is shuffled once, after equal ones of a task are merged; the header side
holds no payload, so that a payload which a third of all records share costs a small row for
each. No record needs another one in its task.

Defined cases: null html is the empty payload; a null url leaves the target out, and line
ends in a url are percent-encoded; rows with an equal, largest id and equal payload are all
responses; a null id never is the largest unless all ids of the payload are null, and then
all are responses; empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import base32_of_hex
from .common import staging_path

_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ADDRESS = ["sha256", "sha1", "bytes"]
_DATE = "2024-01-01T00:00:00Z"


def _addressed(payload: Column) -> list[Column]:
    return [F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes")]


def _uri(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = _DATE) -> None:
    """Writes a record for each row of pages (page_id, url, html) into the folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", *_addressed(F.col("payload")))
    rows.select(*_ADDRESS, "payload").groupBy(*_ADDRESS).agg(F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = rows.drop("payload")
    owner = light.where(F.col("bytes") >= min_bytes).groupBy(*_ADDRESS).agg(F.max("page_id").alias("owner"))
    d = light.join(owner, _ADDRESS, "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(_EOL + _EOL))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _uri(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        F.coalesce(_field("WARC-Target-URI", url), F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"), 20))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(_PROFILE)), _field("WARC-Refers-To", _uri(F.col("owner"))), _field("WARC-Truncated", F.lit("length")))).otherwise(F.lit("")),
        _field("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(_EOL),
        http,
    )
    d.select(*_ADDRESS, header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _value(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, rf"\r\n(?i:{name}):[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, from the archive's bytes alone.

    record_id, record_type, refers_to, target_uri, payload_bytes, payload_digest, verified, and
    record (the whole WARC record) and payload, which cost nothing where they aren't selected.
    """
    p = spark.read.parquet(f"{path}/payloads")
    now = dict(zip(_ADDRESS, _addressed(F.col("payload")), strict=True))
    p = p.select(*_ADDRESS, "payload", *[c.alias(f"_{k}") for k, c in now.items()])
    p = p.select(*_ADDRESS, "payload", F.col("_bytes").alias("payload_bytes"), base32_of_hex(F.col("_sha1"), 20).alias("payload_digest"), ((F.col("_sha256") == F.col("sha256")) & (F.col("_sha1") == F.col("sha1")) & (F.col("_bytes") == F.col("bytes"))).alias("_same"))
    h = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    h = h.select(*_ADDRESS, "header", *[_value(text, k).alias(v) for k, v in (("WARC-Record-ID", "record_id"), ("WARC-Type", "record_type"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Payload-Digest", "_said"))])
    whole = F.concat("header", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n"))
    return h.join(p, _ADDRESS, "left").select("record_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", F.coalesce(F.col("_same") & (F.concat(F.lit("sha1:"), "payload_digest") == F.col("_said")), F.lit(False)).alias("verified"), whole.alias("record"), "payload")


def page_of(uri: Column | str) -> Column:
    """The id in `<urn:page:id>`; null where there is none."""
    return F.regexp_extract(uri, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes pages into a new archive in the shared folder and reads its records back."""
    spark = pages.sparkSession
    path = staging_path(spark, "warc-archive")
    write_archive(pages, path, min_bytes=min_bytes)
    r = read_archive(spark, path)
    return r.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"), "verified")
