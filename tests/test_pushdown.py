import gzip
import re

import pytest
from pyspark.sql import functions as F

from tests.test_framing import record
from warcspark.options import WarcOptions
from warcspark.sources.datasource import Range, WarcPushingReader, load
from warcspark.sources.framing import frames


def typed_record(kind, body):
    return record(body).replace(b"WARC-Type: resource", b"WARC-Type: " + kind)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("push")
    for k in range(3):
        (top / f"{k}.warc.gz").write_bytes(b"".join(gzip.compress(typed_record(t, b"x" * 500)) for t in (b"resource", b"Metadata", b"odd") * 5))
    return top


def test_filters_reach_the_source(spark, folder):
    r = load(spark, str(folder))
    one = f"{folder}/1.warc.gz"
    for want, cond in ((15, "record_type = 'resource'"), (15, "record_type in ('metadata', 'response')"), (5, f"record_type = 'metadata' and file_path = '{one}'"), (0, "record_type = 'resource' and record_type = 'metadata'"), (15, "record_type is null"), (30, "record_type is not null"), (3, "record_offset = 0"), (42, "record_offset > 0"), (45, "record_offset >= 0 and block_size < 501")):
        got = r.where(cond)
        assert got.count() == want == load(spark, str(folder), pushdown="false").where(cond).count(), cond
    # Spark applies them to the scan's own columns, and ranges that can't hold anything are no partitions
    plan = r.where("record_type = 'resource'").select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter \(isnotnull\(kind#\d+\) AND \(kind#\d+ = resource\)\)\s+\+- BatchScan warc", plan)
    assert [r.where(c).rdd.getNumPartitions() for c in ("true", f"file_path = '{one}'", "record_type = 'resource' and record_type in ('metadata')")] == [3, 1, 0]
    got = r.where("record_type = 'resource'").select("block_size", "block_digest").distinct().collect()
    assert len(got) == 1 and got[0].block_size == 500


def test_unwanted_blocks_are_not_held():
    import io

    data = typed_record(b"response", b"a" * 100) + typed_record(b"Metadata", b"b" * 100)
    rows = list(frames(io.BytesIO(data), WarcOptions(), types=frozenset({"metadata"})))
    assert [(r["kind"], r["block"] and len(r["block"])) for r in rows] == [("response", None), ("metadata", 100)]


def test_ranges_are_left_out():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

    r = WarcPushingReader({"path": "/nowhere"})
    given = [IsNotNull(("kind",)), In(("kind",), ("response", "metadata")), EqualTo(("kind",), "response"), EqualTo(("file_path",), "/a"), GreaterThan(("record_offset",), 100), LessThan(("record_offset",), 300)]
    assert list(r.pushFilters(given)) == given
    assert r._r.types == {"response"}
    parts = [Range("/a", 0, 100), Range("/a", 0, 101), Range("/a", 100, 200), Range("/a", 200, None), Range("/a", 301, None), Range("/b", 100, 200)]
    assert [r._r.wanted(p) for p in parts] == [False, True, True, True, False, False]
    list(r.pushFilters([EqualTo(("kind",), "metadata")]))
    assert not any(r._r.wanted(p) for p in parts)


def test_built_and_parsed_types_agree(spark):
    from warcspark.operators.build import build_records

    d = spark.createDataFrame([("Response",), ("resource",), ("other",)], "t string")
    got = build_records(d, F.col("t"), F.lit(""), keep=("t",)).select("t", "record_type", "record_type_code").collect()
    assert sorted(map(tuple, got), key=str) == [("Response", "response", 2), ("other", None, 0), ("resource", "resource", 4)]
