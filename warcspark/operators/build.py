"""Records from columns, and records back to bytes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as H
from ..functions import let
from ..options import WarcOptions
from ..schema import ERROR, FIELDS, FINDINGS, RECORD_TYPES, WHOLE
from . import parse

MARK = b"\r\n\r\n"


def _record_id(options: WarcOptions) -> Column:
    made = options.record_id
    if callable(made) and not isinstance(made, Column):
        made = made()
    return made if made is not None else F.concat(F.lit("urn:uuid:"), F.uuid())


def build_records(df: DataFrame, record_type: str | Column, block: str | Column, headers: Mapping[str, Column | str] | Column | None = None, options: WarcOptions | None = None, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """A record for each row: type, block bytes and header fields (null values are left out).

    Missing ids and lengths are added; findings, blocks, digests and repairs are those of parsing.
    `keep` names columns of df that stay beside the record's.
    """
    options = options or WarcOptions()
    if isinstance(record_type, str) and record_type not in RECORD_TYPES:
        raise ValueError(f"unknown record type '{record_type}'")
    kind = F.lit(record_type) if isinstance(record_type, str) else record_type
    content = F.coalesce((F.col(block) if isinstance(block, str) else block).cast("binary"), F.lit(b""))
    given = headers if isinstance(headers, Column) else H.fields([(k, v if isinstance(v, Column) else F.lit(v)) for k, v in (headers or {}).items()])
    h = F.concat(F.array(H.field("WARC-Type", kind)), F.transform(F.coalesce(given, F.array().cast(FIELDS)), lambda x: F.struct(H.normalize_name(x["name"]).alias("name"), x["value"].alias("value"))))
    major, minor = options.version.split(".")
    d = df.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], content.alias("block"), F.filter(h, lambda x: x["value"].isNotNull()).alias("headers"))
    if options.add_missing_record_id:
        d = d.withColumn("_new_id", _record_id(options)).withColumn("headers", let(F.col("headers"), lambda h: F.when(H.has(h, "WARC-Record-ID"), h).otherwise(H.add_id(h, "WARC-Record-ID", F.col("_new_id")))))
    if options.add_missing_content_length:
        d = d.withColumn("headers", let(F.col("headers"), lambda h: F.when(H.has(h, "Content-Length"), h).otherwise(H.add(h, "Content-Length", F.octet_length("block").cast("string")))))
    none = {"file_path": "string", "record_offset": "long", "record_size": "long", "skipped_bytes": "long", "is_gzip": "boolean", "whole": WHOLE, "error": ERROR}
    d = d.withColumns({k: F.lit(None).cast(v) for k, v in none.items()} | {"version": F.lit(options.version), "version_major": F.lit(int(major)), "version_minor": F.lit(int(minor)), "kind": H.type_name(H.type_code(H.get("headers", "WARC-Type"))), "block_truncated": F.lit(False), "before": F.array().cast(FINDINGS), "after": F.array().cast(FINDINGS)})
    return parse.typed(d, options, keep=[f"_keep_{c}" for c in keep]).withColumnsRenamed({f"_keep_{c}": c for c in keep})


def marshal(version: Column | str = "version", headers: Column | str = "headers", block: Column | str = "block") -> Column:
    """The bytes of a record: version line, fields, empty line, block, end mark."""

    def c(x: Column | str) -> Column:
        return F.col(x) if isinstance(x, str) else x

    head = F.concat(F.lit("WARC/"), c(version), F.lit("\r\n"), H.serialize(c(headers)), F.lit("\r\n"))
    return F.concat(F.encode(head, "UTF-8"), F.coalesce(c(block), F.lit(b"")), F.lit(MARK))


def serialize_block(kind: Column | str, header_bytes: Column, payload: Column, warc_fields: Column) -> Column:
    """A block's bytes from its parts: protocol header and payload, or fields and an empty line."""
    k = F.col(kind) if isinstance(kind, str) else kind
    fields_block = F.encode(F.concat(H.serialize(warc_fields), F.lit("\r\n")), "UTF-8")
    return F.when(k.isin("http_request", "http_response"), F.concat(header_bytes, payload)).when(k == "revisit", header_bytes).when(k == "warc_fields", fields_block).otherwise(payload)


def http_response(status: Column | str, fields: Mapping[str, Column | str], payload: Column) -> Column:
    """Bytes of an HTTP/1.1 response."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit("\r\n")) for k, v in fields.items()]
    s = status if isinstance(status, Column) else F.lit(status)
    return F.concat(F.encode(F.concat(F.lit("HTTP/1.1 "), s, F.lit("\r\n"), *lines, F.lit("\r\n")), "UTF-8"), payload.cast("binary"))


