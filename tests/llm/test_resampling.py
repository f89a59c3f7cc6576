import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from warcspark.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def spelled(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute(rows, target, percent=25, least=20, buckets=10_000):
    of = lambda fs: [zlib.crc32(f.encode()) % buckets for f in fs]
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for _, x in rows:
        np.add.at(s, of(spelled(x)[1]), 1)
    for x in target:
        np.add.at(t, of(spelled(x)[1]), 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + buckets) / ((int(a) + 1) * (int(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        words, fs = spelled(x)
        weight = sum(gain[b] for b in of(fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted(str(tuple(r[:5])) for r in out)


def test_features_are_those_of_the_words():
    rng = random.Random(1)
    words = ["Aa", "b2", "É", "漢", "x" * 62, "y" * 63, "z" * 64, "é" * 40, "q" * 500, "7"]
    texts = [None, "", "one", ", . !", *(" ".join(rng.choice(words) + rng.choice(["", ",", "-"]) for _ in range(rng.randint(1, 30))) for _ in range(200))]
    rows, at, n = R.features(pa.array(texts, pa.string()), 1 << 33)
    for i, t in enumerate(texts):
        w, fs = spelled(t)
        assert n[i] == len(w) and sorted(at[rows == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in fs)


def test_like_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ON"]
    rows = [(None, None), (None, "a b"), (1, ""), (2, "!!"), (3, "one " * 30_000)]
    rows += [(rng.randint(10, 300) if k % 7 else None, " ".join(rng.choice(words[k % 40 :]) for _ in range(rng.randint(0, 60)))) for k in range(600)]
    rows += [rows[100]] * 200  # a third of all rows
    target = ["w1 w2 w3", None, "on w40 w41 w42", "w40 w41"]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string")
    for c in ("score", "weight", "rank", "words", "_at", "_part", "_tie", "_n", "bucket", "n_features"):
        docs, bench = docs.withColumn(c, F.lit("clash")), bench.withColumn(c, F.lit("clash"))
    for how in ({}, {"percent": 50, "least": 0}, {"percent": 100, "buckets": 50}, {"percent": 0}):
        got = sorted(str(tuple(r)) for r in R.resample(docs, bench, **how).select("doc_id", "n_features", "weight", "score", "rank").collect())
        assert got == brute(rows, target, **how)
    assert R.resample(docs.limit(0), bench).collect() == []
    assert R.resample(docs, bench.limit(0)).where("rank is not null").count() == 25 * sum(len(spelled(t)[0]) >= 20 for _, t in rows) // 100


def test_cutoffs(spark):
    rng = random.Random(4)
    rows = [(rng.randint(-5, 5), rng.randint(0, 40) if rng.random() < 0.9 else None) for _ in range(700)] + [(0, 7)] * 300
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(6)
    keys = sorted((-s, R._LAST if i is None else i) for s, i in rows)
    for k in (1, 2, 333, 500, 700, 1000):
        assert R.cutoff(df, k) == keys[k - 1]


def test_a_weighted_median_leaves_a_quarter_on_either_side():
    rng = random.Random(5)
    for _ in range(200):
        tasks = [sorted(rng.randint(0, 50) for _ in range(rng.choice([1, 2, 9, 60]))) for _ in range(rng.randint(1, 9))]
        m, _ = pivot = R.weighted_median([((t[(len(t) - 1) // 2], 0), len(t)) for t in tasks])
        every = [x for t in tasks for x in t]
        assert 4 * sum(x <= m for x in every) >= len(every) and 4 * sum(x >= m for x in every) >= len(every)
