"""Records from bytes: framing in Python, all the rest as expressions.

`parse_records` takes any column of archive bytes and gives a row for each record with the
columns of schema.RECORD_COLUMNS. Framing sends each record's bytes to the JVM once; types, ids,
times, blocks, digests and findings are projections there, so a query that doesn't ask for them
doesn't pay for them.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import blocks as B
from ..functions import digest as D
from ..functions import fields as H
from ..functions import let
from ..options import IGNORE, WarcOptions
from ..schema import FIELDS, FRAMED, RECORD_COLUMNS
from ..sources.framing import frames
from . import validate as V

#: Rows and bytes of an Arrow batch of framed records, at most (one record may be larger).
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def batches_of(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("block") or b"") + 500
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def frame(df: DataFrame, data: str, options: WarcOptions, *, base: str | None = None, path: str | None = None, with_block: bool = True, one: bool = False) -> DataFrame:
    """Framed records of a binary column; `base` names a column of offsets, `path` one of file names."""
    schema = to_arrow_schema(FRAMED)
    plain = options.but(record_id=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    raw = b.column(0)[i].as_py()
                    if raw is not None:
                        yield from frames(io.BytesIO(raw), plain, offset=b.column(1)[i].as_py() or 0, path=b.column(2)[i].as_py(), with_block=with_block, one=one)

        return batches_of(rows(), schema)

    args = [F.col(data).cast("binary").alias("_d"), (F.col(base) if base else F.lit(0)).cast("long").alias("_o"), (F.col(path) if path else F.lit(None)).cast("string").alias("_p")]
    return df.select(*args).mapInArrow(run, FRAMED)


class Steps:
    """Takes down what is done to a frame's columns, to do it to others again: building the expressions of a
    record takes longer than planning them, and they are the same for every frame."""

    def __init__(self, columns: list[str]) -> None:
        self.columns, self.done = list(columns), []

    def withColumns(self, new: dict[str, Column]) -> Steps:
        self.columns += [c for c in new if c not in self.columns]
        self.done.append(lambda df: df.withColumns(new))
        return self

    def withColumn(self, name: str, value: Column) -> Steps:
        return self.withColumns({name: value})

    def drop(self, *names: str) -> Steps:
        self.columns = [c for c in self.columns if c not in names]
        self.done.append(lambda df: df.drop(*names))
        return self


@lru_cache(maxsize=32)
def _steps(options: WarcOptions, gateway: int) -> list[Callable[[DataFrame], DataFrame]]:
    """Of one JVM, as expressions live there."""
    return _typed(Steps(FRAMED.names), options).done


def typed(df: DataFrame, options: WarcOptions, *, keep: list[str] | None = None) -> DataFrame:
    """All columns of records, from framed ones (or built ones that look alike), after those to keep."""
    for step in _steps(options.but(record_id=None), id(SparkContext._gateway)):
        df = step(df)
    return df.select(*(keep or []), *RECORD_COLUMNS)


def _typed(df: Steps, options: WarcOptions) -> Steps:
    code, type_found = V.resolve_type("headers", options)
    df = df.withColumn("record_type_code", code).withColumn("_type_found", type_found)
    kinds = H.get("headers", "Content-Type")
    minor, major = F.coalesce("version_minor", F.lit(0)), F.coalesce("version_major", F.lit(0))
    head = V.header_findings("headers", F.col("record_type_code"), minor, major) if options.spec != IGNORE else V.no_findings()
    df = df.withColumn("_head", F.when(F.col("headers").isNotNull() & F.col("error").isNull(), F.concat("_type_found", head)).otherwise(V.no_findings()))
    if options.blank_invalid and options.spec != IGNORE:
        df = df.withColumn("headers", V.blanked("headers", F.col("record_type_code"), minor, major))
    df = df.withColumn("block_kind", F.when(F.col("headers").isNotNull(), B.block_kind("record_type_code", kinds, "block", parse=options.parse_block)))
    is_http = F.col("block_kind").isin("http_request", "http_response")
    df = df.withColumn("_cut", F.when(is_http, B.http_head_length("block")))  # null for all but HTTP blocks
    http = F.col("_cut").isNotNull()
    # of a block that goes on beyond what the row holds nobody says that its header has no end
    df = df.withColumn("_open", F.coalesce((F.col("_cut") == 0) & F.col("whole").isNull(), F.lit(False)))
    missing = V._some(F.when(F.col("_open"), V.finding("syntax", "the HTTP header has no empty line at its end", kind="http_headers")))
    short = http & (F.octet_length("block") < 4)
    df = df.withColumn("error", F.coalesce(F.col("error"), F.when(short, F.struct(F.lit("http").alias("kind"), F.lit("the block is too short for an HTTP message").alias("msg")))))
    if options.fix_syntax_errors:
        fixable = F.col("_open") & ~short & F.col("whole").isNull()
        longer = lambda h: H.set_(h, "Content-Length", (F.coalesce(H.get_int64(h, "Content-Length"), F.lit(0)) + 2).cast("string"))
        df = df.withColumn("headers", let(F.col("headers"), lambda h: F.when(fixable, longer(h)).otherwise(h)))
        df = df.withColumn("block", F.when(fixable, F.concat("block", F.lit(b"\r\n"))).otherwise(F.col("block")))
    offset = let(F.col("_cut"), lambda c: F.when(c > 0, c).when((c == 0) | (F.col("block_kind") == "revisit"), F.octet_length("block")).otherwise(0))
    df = df.withColumn("payload_offset", offset.cast("int")).withColumn("payload", B.payload("block", "payload_offset"))
    df = df.withColumn("http", F.when(http & F.col("error").isNull(), B.http_struct("block", F.col("payload_offset"), F.col("_open"))))
    unread = http & F.col("error").isNull() & F.when(F.col("block_kind") == "http_response", F.col("http.status_line").isNull()).otherwise(F.col("http.request_uri").isNull())
    block_found = V._some(F.when(unread, V.finding("block", F.concat(F.lit("the first line can't be read as that of an "), F.translate("block_kind", "_", " ")), kind="http")))
    text = F.when(F.col("block_kind") == "warc_fields", F.decode("block", "UTF-8"))
    df = df.withColumn("warc_fields", H.parse_lenient(text, words=True).cast(FIELDS))
    df = df.withColumn("_fields_found", F.coalesce(F.when(F.col("block_kind") == "warc_fields", V.line_findings(text)), V.no_findings()))
    loose = (F.size("_fields_found") > 0) & F.col("whole").isNull()
    fields_found = F.col("_fields_found")
    if options.fix_warc_fields:
        df = df.withColumn("block", F.when(loose, F.encode(H.serialize("warc_fields"), "UTF-8")).otherwise(F.col("block")))
    df = df.withColumn("validation", F.concat("before", "_head", missing, block_found, fields_found))
    df = V.validate_digests(df, options)
    df = df.withColumn("validation", F.concat("validation", "after"))
    df = V.apply_policies(df, options)
    df = df.withColumn("block_size", F.coalesce(F.col("whole.size"), F.octet_length("block").cast("long")))
    large = F.col("whole").isNotNull()
    default = F.lit(options.default_algorithm)
    ready = lambda part: D.format_field(default, D.encoded(F.try_element_at(f"whole.{part}", default), F.lit(options.default_encoding)))
    own = H.get("headers", "WARC-Block-Digest")
    same = let(D.parse_field(own, options.default_encoding), lambda p: D.format_field(p["algorithm"], F.when(large, D.encoded(F.try_element_at("whole.block", p["algorithm"]), p["encoding"])).otherwise(D.compute("block", p["algorithm"], p["encoding"]))))
    sound = F.col("block").isNotNull() & ~F.coalesce(F.col("block_truncated"), F.lit(False))
    df = df.withColumn("block_digest", F.when(sound, F.coalesce(same, D.digest_field("block", options.default_algorithm, options.default_encoding))).when(large, F.coalesce(same, ready("block"))))
    said = H.get("headers", "WARC-Payload-Digest")
    computed = F.when(http & sound, D.digest_field("payload", options.default_algorithm, options.default_encoding)).when(http & large, ready("payload")).when((F.col("record_type_code") == 4) & (sound | large), F.col("block_digest"))
    df = df.withColumn("payload_digest", F.coalesce(said, computed))
    named = {
        "record_type": F.col("kind"),
        "record_id": H.get_id("headers", "WARC-Record-ID"),
        "content_length": H.get_int64("headers", "Content-Length"),
        "warc_date_raw": H.get("headers", "WARC-Date"),
        "warc_date": H.get_time("headers", "WARC-Date"),
        "target_uri": H.get("headers", "WARC-Target-URI"),
        "content_type": H.get("headers", "Content-Type"),
    }
    return df.withColumns(named)


def parse_records(df: DataFrame, data: str = "content", options: WarcOptions | None = None, *, base: str | None = None, path: str | None = None, with_block: bool = True) -> DataFrame:
    """All records of the archives in a binary column of df.

    A fatal error ends its archive with a row whose `error` says why. Null data gives no rows.
    """
    options = options or WarcOptions()
    return typed(frame(df, data, options, base=base, path=path, with_block=with_block), options)


def parse_record(df: DataFrame, data: str = "content", options: WarcOptions | None = None) -> DataFrame:
    """The first record only of the bytes in each row."""
    options = options or WarcOptions()
    return typed(frame(df, data, options, one=True), options)


def headers_only(df: DataFrame, data: str = "content", *, base: str | None = None, path: str | None = None) -> DataFrame:
    """Headers and places of all records; blocks are skipped, not kept or hashed."""
    options = WarcOptions.no_validation()
    return typed(frame(df, data, options, base=base, path=path, with_block=False), options).drop("block", "http", "warc_fields", "payload_offset", "block_size", "block_digest", "payload_digest")


def read_files(spark, paths: str | list[str], options: WarcOptions | None = None, *, with_block: bool = True) -> DataFrame:
    """Records of whole files through Spark's own file readers, for any store that Spark can read. Files must be
    below 2 GB; larger ones go through the `warc` data source or an index of ranges."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return parse_records(files, "content", options, path="path", with_block=with_block)


def findings(df: DataFrame) -> DataFrame:
    """A row for each finding."""
    return df.select("file_path", "record_offset", "record_id", F.explode("validation").alias("f")).select("file_path", "record_offset", "record_id", "f.*")

