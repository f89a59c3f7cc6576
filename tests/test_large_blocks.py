import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from tests.test_commit import files
from warcspark.functions import digest as D
from warcspark.operators import parse as P
from warcspark.operators import revisit as R
from warcspark.options import WarcOptions
from warcspark.sources.datasource import block_chunks, load

RNG = random.Random(7)
HTTP = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"


def one(block, kind="resource", media="text/plain", block_digest=None, payload_digest=None, length=None, k=0):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:b:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", "http://x/"), ("Content-Type", media), ("Content-Length", str(len(block) if length is None else length))]
    head += [(n, v) for n, v in (("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload_digest)) if v]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in head).encode() + b"\r\n" + block + b"\r\n\r\n")


def b32(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_blocks_beyond_a_row_are_judged_as_a_whole(spark, tmp_path):
    body = RNG.randbytes(300_000)
    web = HTTP + body
    made = [
        one(body, block_digest=b32(body), payload_digest="sha-256:" + hashlib.sha256(body).hexdigest(), k=0),
        one(web, "response", "application/http", b32(web), b32(body), k=1),
        one(web, "response", "application/http", b32(body), b32(web), k=2),
        one(body, block_digest="md5:" + hashlib.md5(body[:-1]).hexdigest(), k=3),
        one(body, k=4),
        one(b"small", block_digest=b32(b"small"), k=5),
        one(b"HTTP/1.1 200 OK\r\nX: " + b"y" * 3000 + b"\r\n\r\n" + body, "response", "application/http", payload_digest=b32(body), k=6),
        one(body, length="000" + str(len(body)), k=7),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made))
    full = {r.record_id: r for r in load(spark, str(tmp_path)).collect()}
    cut = {r.record_id: r for r in load(spark, str(tmp_path), WarcOptions(max_block_bytes=1000)).collect()}
    assert len(cut) == 8 == len(full)
    for i, r in cut.items():
        a = full[i]
        assert (r.block_size, r.block_digest, r.validation, r.error, r.content_length, r.record_size) == (a.block_size, a.block_digest, a.validation, a.error, a.content_length, a.record_size), i
        assert bytes(r.block) == bytes(a.block)[:1000] and r.block_truncated == (a.block_size > 1000) and not a.block_truncated
        if i != "urn:b:6":
            assert r.payload_digest == a.payload_digest
    assert [len(cut[f"urn:b:{k}"].validation) for k in range(8)] == [0, 0, 2, 1, 0, 0, 0, 1]
    # repairs take the whole block's values too
    fixed = {r.record_id: r for r in load(spark, str(tmp_path), WarcOptions(max_block_bytes=1000)).select("record_id").collect()}
    assert len(fixed) == 8
    o = WarcOptions(max_block_bytes=1000, fix_digest=True, add_missing_digest=True, default_algorithm="sha1", default_encoding="base32")
    archive = spark.createDataFrame([(bytearray(b"".join(made)),)], "content binary")
    heads = {r.record_id: {h.name: h.value for h in r.headers} for r in P.parse_records(archive, "content", o).collect()}
    assert heads["urn:b:2"]["WARC-Block-Digest"] == b32(web) and heads["urn:b:2"]["WARC-Payload-Digest"] == b32(body)
    assert heads["urn:b:4"]["WARC-Block-Digest"] == b32(body) and heads["urn:b:3"]["WARC-Block-Digest"] == "md5:" + hashlib.md5(body).hexdigest()


def test_chunks_are_the_block(spark, tmp_path):
    bodies = [RNG.randbytes(n) for n in (0, 1, 4096, 4097, 100_000)]
    (tmp_path / "c.warc.gz").write_bytes(b"".join(one(b, k=k) for k, b in enumerate(bodies)))
    index = load(spark, str(tmp_path), WarcOptions(max_block_bytes=10)).select("file_path", "record_offset", "record_id", "block_digest")
    got = {}
    for r in block_chunks(index.repartition(3), 4096).orderBy("record_offset", "number").collect():
        parts = got.setdefault(r.record_offset, [])
        assert r.number == len(parts) and r.chunk_offset == 4096 * r.number and 0 < len(r.data) <= 4096
        parts.append(bytes(r.data))
    want = {r.record_offset: bodies[int(r.record_id[-1])] for r in index.collect()}
    assert {k: b"".join(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    digests = {r.record_id: r.block_digest for r in index.collect()}
    assert digests == {f"urn:b:{k}": "sha256:" + hashlib.sha256(b).hexdigest() for k, b in enumerate(bodies)}


def test_a_merge_takes_no_part_of_a_block(spark, tmp_path):
    web = HTTP + b"z" * 5000
    revisit = one(HTTP, "revisit", "application/http", k=9)
    (tmp_path / "m.warc.gz").write_bytes(one(web, "response", "application/http", k=1))
    (tmp_path / "r.warc.gz").write_bytes(revisit)
    o = WarcOptions(max_block_bytes=1000)
    r = load(spark, str(tmp_path), o)
    assert len(files(tmp_path)) == 2
    refers = r.where("record_type = 'revisit'").withColumn("headers", F.concat("headers", F.array(F.struct(F.lit("WARC-Refers-To").alias("name"), F.lit("<urn:b:1>").alias("value")))))
    got = R.merge(refers, r.where("record_type = 'response'"), o).first()
    assert got.error.kind == "merge" and "all of the block" in got.error.msg


def test_encoded_digests(spark):
    d = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(*[D.encoded(F.unhex(F.sha1("b")), F.lit(e)).alias(e) for e in ("base16", "base32", "base64")]).first()
    raw = hashlib.sha1(b"abc").digest()
    assert tuple(d) == (raw.hex(), base64.b32encode(raw).decode(), base64.b64encode(raw).decode())
