"""Record types, versions, header-field rules and the columns of a record."""

from __future__ import annotations

from pyspark.sql import types as T

#: Record types and their bit codes; 0 is an unknown type.
RECORD_TYPES = {
    "warcinfo": 1,
    "response": 2,
    "resource": 4,
    "request": 8,
    "metadata": 16,
    "revisit": 32,
    "conversion": 64,
    "continuation": 128,
}
ALL_TYPES = 255

#: Revisit profiles.
PROFILE_IDENTICAL_1_0 = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PROFILE_IDENTICAL_1_1 = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PROFILE_NOT_MODIFIED_1_0 = "http://netpreserve.org/warc/1.0/revisit/server-not-modified"
PROFILE_NOT_MODIFIED_1_1 = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
IDENTICAL_PROFILES = (PROFILE_IDENTICAL_1_0, PROFILE_IDENTICAL_1_1)
PROFILES = (*IDENTICAL_PROFILES, PROFILE_NOT_MODIFIED_1_0, PROFILE_NOT_MODIFIED_1_1)


def _in(*types: str) -> int:
    """Bit mask of record types."""
    return sum(RECORD_TYPES[t] for t in types)


def _but(*types: str) -> int:
    return ALL_TYPES - _in(*types)


_CAPTURES = ("response", "resource", "request", "metadata", "revisit")

#: Field, value check, allowed record types, versions (1: 1.0, 2: 1.1, 0: never checked). They are those of the
#: WARC standard, but for the last three, which crawlers use. Only WARC-Concurrent-To and unknown fields may repeat.
FIELD_RULES = {
    "Content-Length": ("long", ALL_TYPES, 3),
    "Content-Type": ("", ALL_TYPES, 3),
    "WARC-Block-Digest": ("", ALL_TYPES, 3),
    "WARC-Concurrent-To": ("id", _in(*_CAPTURES), 3),
    "WARC-Date": ("time", ALL_TYPES, 3),
    "WARC-Filename": ("", _in("warcinfo"), 3),
    "WARC-IP-Address": ("ip", _in(*_CAPTURES), 3),
    "WARC-Identified-Payload-Type": ("", ALL_TYPES, 3),
    "WARC-Payload-Digest": ("", ALL_TYPES, 3),
    "WARC-Profile": ("uri", _in("revisit"), 3),
    "WARC-Record-ID": ("id", ALL_TYPES, 3),
    "WARC-Refers-To": ("id", _in("metadata", "revisit", "conversion"), 3),
    "WARC-Refers-To-Date": ("time", _in("revisit"), 2),
    "WARC-Refers-To-Target-URI": ("uri", _in("revisit"), 2),
    "WARC-Segment-Number": ("int", ALL_TYPES, 3),
    "WARC-Segment-Origin-ID": ("id", _in("continuation"), 3),
    "WARC-Segment-Total-Length": ("long", _in("continuation"), 3),
    "WARC-Target-URI": ("uri", ALL_TYPES, 3),
    "WARC-Truncated": ("", ALL_TYPES, 3),
    "WARC-Type": ("", ALL_TYPES, 3),
    "WARC-Warcinfo-ID": ("id", _but("warcinfo"), 3),
    "WARC-Page-ID": ("", _but("warcinfo"), 0),
    "WARC-Resource-Type": ("", _but("warcinfo"), 0),
    "WARC-JSON-Metadata": ("", _but("warcinfo"), 0),
}
REPEATABLE = ("WARC-Concurrent-To",)
REQUIRED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

FIELD = "struct<name:string,value:string>"
FIELDS = f"array<{FIELD}>"
FINDING = "struct<category:string,kind:string,field:string,line:int,msg:string,expected:string,actual:string>"
FINDINGS = f"array<{FINDING}>"
ERROR = "struct<kind:string,msg:string>"


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_FINDINGS = T.ArrayType(_struct(category=_S, kind=_S, field=_S, line=_I, msg=_S, expected=_S, actual=_S))

#: Of a block that a row holds the beginning of only: its size, and digests of all of it and of its payload by algorithm.
WHOLE = "struct<size:bigint,block:map<string,binary>,payload:map<string,binary>>"
_WHOLE = _struct(size=_L, block=T.MapType(_S, T.BinaryType()), payload=T.MapType(_S, T.BinaryType()))

#: What framing makes of bytes: everything but what expressions can derive, and the record type (kind), so that filters on it
#: reach the source.
FRAMED = _struct(
    file_path=_S, record_offset=_L, record_size=_L, skipped_bytes=_L, is_gzip=_B, version=_S, version_major=_I, version_minor=_I,
    kind=_S, headers=T.ArrayType(_struct(name=_S, value=_S)), block=T.BinaryType(), block_truncated=_B, whole=_WHOLE, before=_FINDINGS, after=_FINDINGS, error=_struct(kind=_S, msg=_S),
)

#: The columns of a parsed record, in order.
RECORD_COLUMNS = [
    "file_path", "record_offset", "record_size", "skipped_bytes", "is_gzip", "version", "version_major", "version_minor", "record_type",
    "record_type_code", "headers", "record_id", "content_length", "warc_date", "warc_date_raw", "target_uri", "content_type", "block_kind",
    "block", "block_size", "block_truncated", "http", "payload_offset", "warc_fields", "block_digest", "payload_digest", "validation", "error",
]

