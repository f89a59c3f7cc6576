"""Near-duplicate documents: SetSketch registers, banded; joint likelihood estimate; exact check.

A document's set is that of its distinct 5-word shingles, as 64-bit hashes. Its sketch has M
registers 1 + floor(-log_BASE x), where x is the smallest of the set's values under an
exponential law of rate RATE for that register: exponentially spaced, truncated minima that
merge by maximum. Two registers agree with a probability near the Jaccard similarity J, for
BASE = 1.2 and sets of like size 0.769 at J = 0.75. Bands of ROWS registers are bucket keys;
with BANDS bands a link at exactly 0.75 goes unseen with a chance of 1e-6.

Documents with equal sets form a class at once and only its smallest id goes on, so thousands
of copies cost a row each. Then, instead of all pairs of a bucket:

1. each member of a bucket is paired with one pivot of the bucket, drawn by hash. Pairs are
   estimated from both sketches and exact set sizes by maximum likelihood; those that lie below
   the threshold by more than SIGMAS standard errors go, the rest are checked on full sets;
2. links give components. Where a bucket still holds several, members outside the pivot's
   component meet all of other components: the bucket's members are dealt to blocks and blocks
   meet in pairs. Sketches meet first; members that may have a link meet again with their texts
   and are checked in place, so that only links come out. A pair is looked at in the first band
   it shares. Then components are taken again.

Pairs of a component never meet again, so no link between components is lost. Buckets are never
gathered: pivots come from an aggregate, pairs from joins that adaptive execution splits when a
key is hot; members of buckets of several blocks find their block by a join on bucket and SALTS
hashes, and no task holds more than two blocks of a bucket. Only the texts of documents that
share a bucket are read a second time. What is staged on the way goes as soon as it is used up.

Defined cases: null, empty and blank texts have an empty set, size 0, and link with nothing;
rows with a null id keep their set's size, link with nothing and are kept; rows that repeat an
id are linked by their texts like any others; equal texts always share a component; empty
tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim_cache, column, fresh, release, sliced, staged, temporary
from .components import connected_components

WORDS, PERCENT = 5, 75
BASE, RATE, BANDS, ROWS, SIGMAS, SEED = 1.2, 20.0, 44, 5, 5, 20231
M = BANDS * ROWS
#: Words whose hashes a worker remembers; beyond that it forgets them all and begins anew.
CACHE = 200_000
#: Ids that may be broadcast to pick texts (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a bucket that are held together, about, and parts in which a bucket's members learn their block.
BLOCK, SALTS = 256, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence where it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    s = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(len(w), width)):
        s = (s ^ w[k : k + n]) * _A
        s ^= s >> np.uint64(29)
    s *= _B
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if n > 1 else s


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, M, np.uint64, endpoint=False) | np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The M registers of a set of hashes, as bytes."""
    least = np.full(M, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(least, np.multiply.outer(s[at : at + 512], _multipliers()).min(0), out=least)
    u = (least.astype(np.float64) + 0.5) * 2.0**-64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(1 + np.floor(-np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def _steps(x: np.ndarray) -> np.ndarray:
    """The chance that one register exceeds the other, from the share of the union only one set has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of registers) with known set sizes."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)
    up, down = (np.clip(_steps(np.maximum(y, 0)), 1e-12, 1) for y in (u - v * j, v - u * j))
    score = above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), score.argmax(1)]


def text_hash(text: Column) -> Column:
    """Tells rows of an id with different texts apart."""
    return F.xxhash64(text)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, address of the set (null if empty), registers and hash of the text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("near_dedup", _hashes.clear)
        for b in sliced(batches):
            n, address, regs = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text)
                n.append(len(s))
                address.append(xxhash.xxh3_128_digest(s) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(address, pa.binary()), pa.array(regs, pa.binary()), b.column(1)], ["doc_id", "n_shingles", "address", "registers", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text_hash(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, n_shingles long, address binary, registers binary, text_hash long")


def bands(classes: DataFrame) -> DataFrame:
    """A row (band, node) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.int64)
                key = np.broadcast_to(np.arange(BANDS), r.shape[:2])
                for k in range(ROWS):
                    key = key << 8 | r[:, :, k]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["band", "node"])

    return classes.select("node", "registers").mapInArrow(run, "band long, node long")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """x, y, estimate and whether it is not clearly below the threshold, of pairs (x, y)."""
    c = classes.select("node", F.col("n_shingles").alias("n"), "registers")
    both = pairs.join(c.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("registers").alias("rx")), "x").join(c.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("registers").alias("ry")), "y")
    t = percent / 100
    least = t - SIGMAS * (t * (1 - t) / M) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                rx, ry = (np.frombuffer(b"".join(p.column(i).to_pylist()), np.uint8).reshape(-1, M) for i in (3, 5))
                e = estimate(rx, ry, p.column(2).to_numpy().astype(float), p.column(4).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(e), pa.array(e >= least)], ["x", "y", "near", "open"])

    return both.select("x", "y", "nx", "rx", "ny", "ry").mapInArrow(run, "x long, y long, near double, open boolean")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """node and its compressed text, for the given ids (doc_id)."""
    wanted = staged(ids.distinct(), "near-ids")
    # ids only, and only as many as stated; beyond that the join shuffles
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in b.column(1).to_pylist()], pa.binary())], ["node", "z"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null").join(few, "doc_id", "left_semi")
    return staged(d.mapInArrow(squeeze, "node long, z binary"), "near-texts")


def _set(z: bytes) -> np.ndarray:
    return shingles(zlib.decompress(z).decode("utf-8", "surrogatepass"))


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union."""
    both = len(a) + len(b)
    union = len(np.unique(np.concatenate([a, b])))
    return both - union, union


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """x, y and whether they are linked, of pairs (x, y) of nodes, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_cache("near_dedup", _hashes.clear)
        last, right = None, np.empty(0, np.uint64)
        for b in batches:
            linked = []
            for zx, zy in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if zy != last:
                    last, right = zy, _set(zy)
                common, union = _overlap(_set(zx), right)
                linked.append(union > 0 and 100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    both = pairs.select("x", "y").join(texts.select(F.col("node").alias("x"), F.col("z").alias("zx")), "x").join(texts.select(F.col("node").alias("y"), F.col("z").alias("zy")), "y")
    return both.select("x", "y", "zx", "zy").mapInArrow(run, "x long, y long, linked boolean")


def _candidates(mine: dict, other: dict, same: bool, band: int, percent: int) -> list[tuple[float, int, int]]:
    """Pairs of members of two blocks of a bucket, as (-estimate, p, q) and likeliest first, whose components
    differ, one at least outside the pivot's; a pair is looked at in the first of its bands only."""
    t = percent / 100
    a, b = (np.frombuffer(b"".join(x["registers"]), np.uint8).reshape(-1, M) for x in (mine, other))
    na, nb = (np.array(x["n"], float) for x in (mine, other))
    ca, cb = (np.array(x["component"], np.int64) for x in (mine, other))
    oa, ob = (np.array(x["outside"], bool) for x in (mine, other))
    may = (ca[:, None] != cb[None, :]) & (oa[:, None] | ob[None, :])
    may &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
    i, j = np.nonzero(np.triu(may, 1) if same else may)
    keep: list[tuple[float, int, int]] = []
    for at in range(0, len(i), 2048):
        p, q = i[at : at + 2048], j[at : at + 2048]
        first = (a[p] == b[q]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        p, q = p[first], q[first]
        if len(p):
            e = estimate(a[p], b[q], na[p], nb[q])
            good = e >= t - SIGMAS * (t * (1 - t) / M) ** 0.5
            keep += zip((-e[good]).tolist(), p[good].tolist(), q[good].tolist(), strict=True)
    return sorted(keep)


def _links(pairs: list[tuple[float, int, int]], mine: dict, other: dict, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs on full sets; components that a link has made one are not compared again."""
    merged: dict[int, int] = {}
    sets: dict[tuple[bool, int], np.ndarray] = {}

    def top(c: int) -> int:
        while c in merged:
            c = merged[c]
        return c

    def of(left: bool, k: int) -> np.ndarray:
        if (left, k) not in sets:
            sets[left, k] = _set((mine if left else other)["z"][k])
        return sets[left, k]

    out = []
    for _, p, q in pairs:
        u, v = top(mine["component"][p]), top(other["component"][q])
        if u != v:
            common, union = _overlap(of(True, p), of(same, q))
            if 100 * common >= percent * union:
                merged[max(u, v)] = min(u, v)
                out.append((mine["node"][p], other["node"][q]))
    return out


def _meeting(members: DataFrame, fields: list[str], each: Callable[[dict, dict, bool, int], list[tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
    """What `each` makes of all pairs of blocks of every bucket.

    Members (band, node and the fields) are dealt by hash to blocks of about BLOCK. Only buckets of more than one
    block need a look at their number; a join on the bucket alone would take such a bucket through one task.
    """
    count = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    count = staged(count, "near-counts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(SALTS)).cast("int"))
    dealt = salted.join(count, ["band", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block = staged(dealt.groupBy("band", "block").agg(F.max("blocks").alias("blocks"), F.max("outside").alias("any"), F.collect_list(F.struct(*fields)).alias("m")), "near-blocks")
    right = block.select("band", F.col("block").alias("to"), F.col("any").alias("any2"), F.col("m").alias("m2"))
    left = block.withColumn("to", F.explode(F.sequence("block", F.col("blocks") - 1)))
    met = left.join(right, ["band", "to"]).where("any or any2").select("band", (F.col("block") == F.col("to")).alias("same"), "m", F.when(F.col("block") != F.col("to"), F.col("m2")).alias("m2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(rows: list[dict]) -> dict:
            return {k: [r[k] for r in rows] for k in fields}

        claim_cache("near_dedup", _hashes.clear)
        for b in batches:
            out: list[tuple[int, int]] = []
            for k in range(b.num_rows):
                band, same, m, m2 = (b.column(c)[k].as_py() for c in range(4))
                mine = columns(m)
                out += each(mine, mine if same else columns(m2), same, band)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], list(names))
        release()

    return met.mapInArrow(run, f"{names[0]} long, {names[1]} long")


def across(members: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between components that share a bucket.

    members: band, node, component and outside of all members of the buckets that hold several
    components. Sketches meet first; texts go only to members that some other one may be linked with.
    """

    def may(mine: dict, other: dict, same: bool, band: int) -> list[tuple[int, int]]:
        found = _candidates(mine, other, same, band >> (8 * ROWS), percent)
        return [(band, n) for n in {mine["node"][p] for _, p, _ in found} | {other["node"][q] for _, _, q in found}]

    def link(mine: dict, other: dict, same: bool, band: int) -> list[tuple[int, int]]:
        return _links(_candidates(mine, other, same, band >> (8 * ROWS), percent), mine, other, same, percent)

    fields = ["node", "component", "outside", "n", "registers"]
    full = staged(members.join(sketches, "node"), "near-full")
    left = staged(_meeting(full, fields, may, ("band", "node")).distinct(), "near-members")
    rest = full.join(left, ["band", "node"], "left_semi").join(texts, "node")
    return _meeting(rest, [*fields, "z"], link, ("u", "v")).distinct()


def _found(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: the sketched rows, the classes of equal sets, and the component of each node that is linked."""
    with temporary(docs.sparkSession) as keep:
        rows = keep(staged(sketched(docs), "near-sketches"))
        classes = keep(staged(rows.where("address is not null and doc_id is not null").groupBy("address").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("s")).select(F.col("s.doc_id").alias("node"), "s.n_shingles", "s.registers", "address"), "near-classes"))
        return rows, classes, keep(staged(_components(classes, docs, percent), "near-components"))


def _components(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """node and component of each class that is linked with another one."""
    rough = bands(classes)
    pick = F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node"))
    shared = rough.groupBy("band").agg(pick["node"].alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    buckets = staged(rough.join(shared, "band"), "near-buckets")
    texts = texts_of(buckets.select(F.col("node").alias("doc_id")), docs)
    pairs = buckets.where("node <> pivot").select(F.greatest("node", "pivot").alias("x"), F.least("node", "pivot").alias("y")).distinct()
    guess = staged(plausible(pairs, classes, percent), "near-estimates")
    links = verified(guess.where("open"), texts, percent).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
    part = staged(connected_components(links), "near-components")

    named = buckets.join(part, "node", "left").select("band", "node", "pivot", F.coalesce("component", "node").alias("component"))
    # all pairs with a pivot are done
    others = named.where("node <> pivot")
    mixed = others.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    pivots = part.select(F.col("node").alias("pivot"), F.col("component").alias("home"))
    there = others.join(mixed, "band", "left_semi").join(pivots, "pivot", "left").select("band", "node", "component", (F.col("component") != F.coalesce("home", "pivot")).alias("outside"))
    sketches = classes.select("node", F.col("n_shingles").alias("n"), "registers")
    more = staged(across(staged(there, "near-mixed"), sketches, texts, percent), "near-links")
    if more.isEmpty():
        return part
    return connected_components(part.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    rows, classes, part = _found(docs, percent)
    of_class = classes.select("address", "node").join(part, "node", "left").select("address", F.coalesce("component", "node").alias("component"))
    d = rows.select("doc_id", "n_shingles", "address").join(of_class, "address", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return d.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The rows of docs (doc_id, text and others) that stay: of each group that with the smallest id.

    Of rows that are equal in id and set the one with the smallest hash of the text stays, and of rows equal in id
    and text the one whose columns come first as JSON. Rows that share an id but not their set are different documents;
    rows with a null id are no one's copy and all stay.
    """
    rows, classes, part = _found(docs, percent)
    texts = rows.where("doc_id is not null").groupBy("doc_id", "address", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    # the row that stays has its class's smallest id, so copies of a hot set are told apart by id as they are dealt
    first = classes.join(part, "node", "left").where(F.coalesce("component", "node") == F.col("node")).select(F.col("address").alias("_a"), F.col("node").alias("_n"))
    sets = texts.join(first, (F.col("address") == F.col("_a")) & (F.col("doc_id") == F.col("_n")), "left_semi").unionByName(texts.where("address is null"))
    sets = sets.groupBy("doc_id", "address").agg(F.min(F.struct("text_hash", "_rows")).alias("s"))
    p, cols = fresh(docs.columns), [column(c) for c in docs.columns]
    sets = staged(sets.select(F.col("doc_id").alias(p + "id"), F.col("s.text_hash").alias(p + "hash"), F.col("s._rows").alias(p + "rows")), "near-kept")
    d = docs.where("doc_id is not null").withColumn(p + "hash_of", text_hash(F.col("text").cast("string")))
    d = d.join(sets, (F.col("doc_id").cast("long") == F.col(p + "id")) & (F.col(p + "hash_of") == F.col(p + "hash")))
    order = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    again = d.where(F.col(p + "rows") > 1).groupBy(p + "id", p + "hash").agg(F.min_by(F.struct(*cols), order).alias("s")).select("s.*")
    return d.where(F.col(p + "rows") == 1).select(*cols).union(again).union(docs.where("doc_id is null"))
