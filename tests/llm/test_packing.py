import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from warcspark.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))


def test_ids_are_the_tokenizers(tokenizer):
    w = P.WordIds(P.vocabulary_path())
    rng = random.Random(1)
    pool = "ab'sdtre vmlSDTÉéßñÑ1290.,;:!?<|>&*%$#\x1c\x1f\x85\xa0 \n\t\r\x0b\x0cİıſK漢字éẞ ́"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["a<|endoftext|>b c", "<|startoftext|>", "it's we'll ''s 's I'M DON'T", "The quick brown fox!", ""]
    for t in texts:
        assert np.frombuffer(w.of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_bins_are_the_tightest():
    rng = random.Random(2)
    for length in (1, 7, 50, 64):
        sizes = sorted((rng.randint(1, length) for _ in range(300)), reverse=True)
        number, offset, n = P.best_fit_decreasing(np.array(sizes), length)
        rest = []  # the plain way: look at all bins
        for size, k, at in zip(sizes, number, offset, strict=True):
            fits = [r for r in rest if r >= size]
            if fits:
                assert rest[k] == min(fits) and at == length - rest[k]
                rest[k] -= size
            else:
                assert k == len(rest) and at == 0
                rest.append(length - size)
        assert n == len(rest)


def test_pieces_and_places(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a b c " * 2000), (4, "hello world"), (4, "hello world"), (None, "x"), (5, " ".join(f"word{i}" for i in range(1500)))]
    rows += [(100 + i, "tok " * (i * 7 % 400)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("shard", F.lit("clash"))
    got = P.pack(df, length=256, shard_pieces=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, want))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    least = -(-sum(n for *_, n, _ in want) // 256)
    assert len(by) <= least + 6
    assert P.pack(df.limit(0)).count() == 0


def test_equal_rows_spread_over_shards(spark):
    """A hot row, with null ids: no shard gets more than its bound, and all are packed."""
    df = spark.range(40_000, numPartitions=3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    got = P.pack(df, length=16, shard_pieces=4096)
    per = got.groupBy((F.col("sequence_id") / (1 << 31)).cast("long")).count().collect()
    assert sum(r["count"] for r in per) == 40_000 and len(per) >= 10 and max(r["count"] for r in per) <= 4096
    assert got.groupBy("sequence_id").count().where("count > 16").count() == 0
