"""Writers dealt by bytes, and revisits across the batches of a stream."""

import time

from pyspark.sql import functions as F

from warcspark.functions import digest as D
from warcspark.functions import fields as H
from warcspark.operators import revisit as R
from warcspark.operators.build import build_records, http_response
from warcspark.sources import sink as K
from warcspark.sources.datasource import load
from warcspark.streaming import deduplicate_stream


def captures(spark, rows):
    d = spark.createDataFrame(rows, "id long, day int, body string")
    h = {"WARC-Record-ID": F.format_string("<urn:r:%d>", "id"), "WARC-Date": F.format_string("2024-01-%02dT00:00:00Z", "day"), "WARC-Target-URI": F.lit("http://x.example/"), "Content-Type": F.lit("application/http; msgtype=response"), "WARC-Payload-Digest": F.when(F.col("body") != "none", D.digest_field("body", "sha1"))}
    return build_records(d, "response", http_response(F.lit("200 OK"), {}, F.col("body")), h, keep=("id", "day"))


def run(spark, folder, state, out, seen, **more):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(number)
        if more.get("fail") == number:
            raise RuntimeError("lost")

    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = deduplicate_stream(stream, write, state, order=("day", "id"), ttl_ms=more.get("ttl_ms"), trigger={"availableNow": True})
    try:
        q.awaitTermination()
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)


def refs(spark, out):
    d = spark.read.parquet(f"{out}/*").select("id", R.revisit_ref()["target_record_id"].alias("to"), "record_type")
    return {r.id: r.to and int(r.to.rpartition(":")[2]) for r in d.collect()}


def test_revisits_across_batches(spark, tmp_path):
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    provider, seen = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), []
    captures(spark, [(3, 9, "a"), (2, 8, "a"), (4, 7, "b"), (5, 5, "none"), (6, 5, "none")]).write.parquet(folder)
    run(spark, folder, state, out, seen)
    assert refs(spark, out) == {2: None, 3: 2, 4: None, 5: None, 6: None}
    # a date before the first one written comes late: it is a revisit all the same; the batch fails once written, and comes again
    captures(spark, [(7, 1, "a"), (8, 9, "b"), (9, 9, "c"), (10, 9, "c")]).write.mode("append").parquet(folder)
    run(spark, folder, state, out, seen, fail=1)
    run(spark, folder, state, out, seen)
    assert seen == [0, 1, 1]
    assert refs(spark, out) == {2: None, 3: 2, 4: None, 5: None, 6: None, 7: 2, 8: 4, 9: None, 10: 9}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    merged = R.merge(spark.read.parquet(f"{out}/*").where("record_type = 'revisit'"), captures(spark, [(2, 8, "a"), (4, 7, "b"), (9, 9, "c")]).drop("id", "day"))
    assert {r.id: bytes(r.block).rpartition(b"\r\n\r\n")[2] for r in merged.select("id", "block").collect()} == {3: b"a", 7: b"a", 8: b"b", 10: b"c"}


def test_payloads_are_forgotten(spark, tmp_path):
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    captures(spark, [(1, 1, "a"), (2, 2, "a")]).write.parquet(folder)
    run(spark, folder, state, out, [], ttl_ms=1000)
    time.sleep(2)
    captures(spark, [(3, 3, "a"), (4, 4, "a")]).write.mode("append").parquet(folder)
    run(spark, folder, state, out, [], ttl_ms=1000)
    assert refs(spark, out) == {1: None, 2: 1, 3: None, 4: 3}


def test_writers_are_dealt_by_bytes(spark, tmp_path):
    # one group holds a third of all bytes, and no group is split
    d = spark.range(3000).withColumn("g", F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id") % 500)).withColumn("n", F.lit(100) + F.col("id") % 7)
    got = K.deal_by_bytes(d, F.col("g"), F.col("n"), 4)
    assert got.count() == 3000 and got.groupBy("g").agg(F.count_distinct("_writer").alias("w")).where("w > 1").count() == 0
    sums = {r._writer: r.s for r in got.groupBy("_writer").agg(F.sum("n").alias("s")).collect()}
    total = sum(sums.values())
    hot = got.where("g = -1").first()._writer
    assert set(sums) <= set(range(4)) and sums[hot] >= total / 3 and all(s < total / 4 * 1.3 for w, s in sums.items() if w != hot)
    assert K.deal_by_bytes(d.limit(0), F.col("g"), F.col("n"), 4).count() == 0
    even = K.deal_by_bytes(d, F.col("id"), F.when(F.col("id") < 50, 10000).otherwise(F.col("n")), 4).groupBy("_writer").agg(F.sum(F.when(F.col("id") < 50, 10000).otherwise(F.col("n"))).alias("s")).collect()
    assert len(even) == 4 and max(r.s for r in even) < 1.15 * min(r.s for r in even)
    rows = captures(spark, [(i, 1, "x" * (5000 if i < 3 else 50)) for i in range(40)])
    m = K.write_archives(rows, str(tmp_path / "w"), K.WriterOptions(max_file_size=0, compress=False), writers=3, balanced=True)
    assert m.count() == 40 == load(spark, str(tmp_path / "w")).select(H.get_id("headers", "WARC-Record-ID")).distinct().count()
    assert m.select("file_name").distinct().count() == 3
