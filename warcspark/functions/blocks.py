"""Blocks: which kind a record's block is, HTTP messages split and read, warc-fields blocks.

Bytes are looked at as ISO-8859-1 text, which is one character for each byte, so places in the
text are places in the bytes. Nothing leaves Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let
from .fields import parse_lenient

#: Record types whose block may be an HTTP message: response, resource, request, conversion, continuation.
HTTP_TYPES = 2 | 4 | 8 | 64 | 128
REVISIT = 32


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latin1(data: Column | str) -> Column:
    return F.decode(_c(data), "ISO-8859-1")


def block_kind(type_code: Column | str, content_type: Column | str, block: Column | str, *, parse: bool = True) -> Column:
    """generic, http_request, http_response, warc_fields or revisit."""
    if not parse:
        return F.lit("generic")
    given = F.struct(_c(type_code).alias("code"), F.lower(F.coalesce(_c(content_type), F.lit(""))).alias("kind"))

    def which(g: Column) -> Column:
        http = (g["code"].bitwiseAND(HTTP_TYPES) != 0) & g["kind"].startswith("application/http")
        return (
            F.when(http, F.when(F.substring(_c(block), 1, 4) == F.lit(b"HTTP"), "http_response").otherwise("http_request"))
            .when(g["code"] == REVISIT, "revisit")
            .when(g["kind"].startswith("application/warc-fields"), "warc_fields")
            .otherwise("generic")
        )

    return let(given, which)


#: Lines of at least three bytes, then one of fewer, line feed included.
_HEAD = r"^((?:[^\n]{2,}\n)*+[^\n]?\n)"


def http_head_length(block: Column | str) -> Column:
    """Bytes of the HTTP header with its empty line; 0 where that is missing."""
    return F.length(F.regexp_extract(latin1(block), _HEAD, 1))


def http_struct(block: Column | str, head_length: Column, missing_end: Column) -> Column:
    """Request line or status line, and the headers, of an HTTP message."""
    b = _c(block)
    head = F.when(missing_end, b).otherwise(F.substring(b, F.lit(1), head_length))
    text = latin1(head)
    line = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    code = F.regexp_extract(line, r"^HTTP/[0-9]+\.[0-9]+ +([0-9]{3})(?: |$)", 1)
    status = F.regexp_extract(line, r"^HTTP/[0-9]+\.[0-9]+ +([0-9]{3}(?:.*[^ ])?) *$", 1)
    uri = F.regexp_extract(line, r"^\S+ (\S+) HTTP/[0-9]+\.[0-9]+ *$", 1)
    rest = F.regexp_replace(text, r"^[^\n]*\n?", "")
    return F.struct(
        head.alias("header_bytes"),
        F.when(uri != "", uri).alias("request_uri"),
        F.when(status != "", status).alias("status_line"),
        F.when(code != "", code.try_cast("int")).alias("status_code"),
        parse_lenient(rest).alias("headers"),
    )


def payload(block: Column | str, payload_offset: Column | str) -> Column:
    """The bytes after the protocol header."""
    return F.substring(_c(block), _c(payload_offset) + 1, F.octet_length(_c(block)))
