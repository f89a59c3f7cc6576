"""Records of archive bytes as a table function: SELECT * FROM files, LATERAL parse_records(content)."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..options import WarcOptions
from .framing import frames

COLUMNS = "record_offset long, record_size long, skipped_bytes long, is_gzip boolean, version string, headers array<struct<name:string,value:string>>, block binary, findings array<string>, error string"


class ParseRecords:
    """Rows of the records in one value; policies are the defaults."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            for r in frames(io.BytesIO(bytes(content)), WarcOptions()):
                headers = None if r["headers"] is None else [(h["name"], h["value"]) for h in r["headers"]]
                yield (r["record_offset"], r["record_size"], r["skipped_bytes"], r["is_gzip"], r["version"], headers, r["block"], [f["msg"] for f in [*r["before"], *r["after"]]], r["error"] and r["error"]["msg"])


def register(spark: SparkSession, name: str = "parse_records") -> None:
    spark.udtf.register(name, udtf(ParseRecords, returnType=COLUMNS))
