"""Importance resampling towards a target: hashed word features, array-scored weights, weighted median-of-medians selection.

Words are runs of letters, digits and all beyond ASCII, with A to Z lower-cased; features are all runs of one and two
words, hashed into `buckets` by crc32. A bucket's gain is floor(1000 ln(share in the target / share in
the documents)), with one added to each bucket; a document's weight is the floored mean of its features' gains,
its score the weight plus Gumbel noise from its id, so the highest scores are a draw without replacement. Of the documents
with at least `least` words, floor(percent N / 100) are drawn.

The table of counts has one row for each bucket, so it comes to the driver, and goes to every task as an array. The cutoff
is found without a sort: in each round every task gives the median of its scores that are still in question and their
number; the median of these medians, weighted by the numbers, has at least a quarter of what remains on either side, so
at least a quarter is discarded, until the pivot is the cutoff key itself. A task sends three rows to
the driver a round. Only what was drawn is sorted, in ranges; ranks are places in a range plus those of the ranges before.

Scale: texts are read twice (counts, then scores) and never shuffled. Buckets are summed in the tasks before
they are shuffled. Rounds read two numbers a document from a staged table, of which the files' own ranges rule out what is
discarded. crc32 of two words comes from those of each of them, so no pair is spelled out.

Defined cases: null and empty texts have no features and weight 0, and are never drawn with `least` above 0; null ids hash as
'null' and stand behind all others in ties; repeated rows count as often as they stand, and of rows that are equal in score and id
those with fewer features come first; an empty target or table of documents is no exception; texts of any length are whole;
other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import coded_terms, sliced, staged

#: What stands between words: all of ASCII but letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, PERCENT, LEAST, SEED = 10_000, 25, 20, 7
ROWS, BYTES = 8192, 8 << 20
#: Bytes of a word, with the blank before it, up to which tables carry a checksum on.
LONG = 64


def _carry() -> np.ndarray:
    """[n, k, byte]: what byte k of a checksum gives once n more bytes have gone by."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(LONG):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


_CARRY = _carry()


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and the bucket of each feature of the texts, and the number of words of each row."""
    rows, codes, words = coded_terms(texts, BREAKS)
    spelled = [w.encode() for w in words.to_pylist()]
    alone = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))
    after = np.fromiter((zlib.crc32(b" " + w) for w in spelled), np.uint32, len(spelled))
    length = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    first = np.flatnonzero(rows[1:] == rows[:-1])
    a, b = codes[first], codes[first + 1]
    crc, n = alone[a], np.minimum(length[b], LONG)
    both = after[b] ^ _CARRY[n, 0, crc & 255] ^ _CARRY[n, 1, (crc >> 8) & 255] ^ _CARRY[n, 2, (crc >> 16) & 255] ^ _CARRY[n, 3, crc >> 24]
    for i in np.flatnonzero(length[b] > LONG):
        both[i] = zlib.crc32(b" " + spelled[b[i]], int(crc[i]))
    return np.concatenate((rows, rows[first])), np.concatenate((alone[codes], both)).astype(np.int64) % buckets, np.bincount(rows, minlength=len(texts))


def bucket_counts(texts: DataFrame, text_col: str = "text", *, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in sliced(batches, ROWS, BYTES):
            seen += np.bincount(features(b.column(0), buckets)[1], minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target by that in the raw texts, with one added to each bucket."""
    n, all_target, all_raw = len(raw), float(target.sum() + len(target)), float(raw.sum() + len(raw))
    return np.fromiter((math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for t, s in zip(target.tolist(), raw.tolist(), strict=True)), np.int64, n)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, words, n_features and weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, ROWS, BYTES):
            rows, at, words = features(b.column(1), len(gain))
            n = words + np.maximum(words - 1, 0)
            total = np.bincount(rows, weights=gain[at], minlength=b.num_rows).astype(np.int64)  # below 2**53, so exact
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (words, n, total // np.maximum(n, 1)))], ["doc_id", "words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, words long, n_features long, weight long")


Key = tuple[int, int]
#: Stands for a null id, behind all others.
_LAST = (1 << 63) - 1


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first key at which half of the weight is reached."""
    medians = sorted(medians)
    half, run = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        run += n
        if run >= half:
            return key
    raise ValueError("nothing remains")


def cutoff(scores: DataFrame, k: int) -> Key:
    """The k-th key of rows (score, doc_id), highest score first, then smallest id; k is from 1 to their number."""

    def split(low: Key | None, high: Key | None, pivot: Key | None) -> list:
        """Of keys between low and high: how many are before, at and after the pivot in each task, with their medians."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if not got:
                return
            # keys rise as scores fall
            first, second = -np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            rows = []
            before = lambda key: (first < key[0]) | ((first == key[0]) & (second < key[1]))
            after = lambda key: (first > key[0]) | ((first == key[0]) & (second > key[1]))
            inside = (after(low) if low else True) & (before(high) if high else np.ones(len(first), bool))
            for side, mask in ((-1, before(pivot)), (0, ~before(pivot) & ~after(pivot)), (1, after(pivot))) if pivot else ((1, inside),):
                at = np.flatnonzero(mask & inside)
                if len(at):
                    mid = (len(at) - 1) // 2
                    value = np.partition(first[at], mid)[mid]
                    less, same = int((first[at] < value).sum()), at[first[at] == value]
                    rows.append((side, len(at), int(value), int(np.partition(second[same], mid - less)[mid - less])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["side", "n", "first", "second"])

        d = scores.select("score", F.coalesce("doc_id", F.lit(_LAST)).alias("id"))
        if low:
            d = d.where(F.col("score") <= -low[0])
        if high:
            d = d.where(F.col("score") >= -high[0])
        return d.mapInArrow(run, "side long, n long, first long, second long").collect()

    low = high = None
    rows, pivot = split(None, None, None), None
    while True:
        of = {side: [((r["first"], r["second"]), r.n) for r in rows if r.side == side] for side in (-1, 0, 1)}
        n = {side: sum(x for _, x in found) for side, found in of.items()}
        if pivot is None:
            side = 1
        elif k <= n[-1]:
            side, high = -1, pivot
        elif k <= n[-1] + n[0]:
            return pivot
        else:
            k, side, low = k - n[-1] - n[0], 1, pivot
        pivot = weighted_median(of[side])
        rows = split(low, high, pivot)


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with their place by `order`, from 1: ranges are sorted, and each counts on from those before it."""
    laid = staged(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "resample-sorted")
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    laid = laid.withColumn("_part", part).join(F.broadcast(before), "_part")
    return laid.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of docs; target has a column text."""
    gain = gains(bucket_counts(target, buckets=buckets), bucket_counts(docs, buckets=buckets))
    scored = staged(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    fit = scored.where(F.col("words") >= least)
    k = percent * fit.count() // 100
    cols = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*cols, undrawn)
    first, second = cutoff(fit, k)
    key = F.coalesce("doc_id", F.lit(_LAST))
    over = (F.col("words") >= least) & ((F.col("score") > -first) | ((F.col("score") == -first) & (key <= second)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_tie")]
    # rows of one key may be many, so their places in the staged table deal them out
    drawn = ranked(scored.where(over).select(*cols, F.monotonically_increasing_id().alias("_tie")), order, "rank").select(*cols, "rank")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.unionByName(scored.where(~over).select(*cols, undrawn))
