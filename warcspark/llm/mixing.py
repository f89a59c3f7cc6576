"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

All sizes are words. Sources in code-point order (null last) take the weights 1, 2, 3 in turn
and share the total by weight; a target stops at `cap` times its source's size and what it
leaves is shared by the rest, by weight, until no target is above. The total is then cut into
blocks of `block` words. Sainte-Laguë gives the blocks to the sources by highest quotients
target / (2 k + 1), and each source's blocks to its shards by the same rule. Within a shard of
a source the documents stand in a seeded random order and the quota takes whole passes over
them, then the first blocks of that order, so a document at a border may be taken in part.

The quotas come in closed form: every share is first rounded to the nearest whole, which
is off by no more than half a block for each share, and the rest is handed out (or taken
back) by quotients. No row is made for each block.

Scale: text is read once and not shuffled. Rows that are equal in id, source and text are one
row with a number of copies from the first exchange on, merged before it. Documents are dealt by
source and shard: a source has a shard for each SHARD_LEAST rows, SHARDS_FROM at most, and one
for each SHARD_MOST rows if these are more, so a hot source spreads however large it is. The
table of sources has a row for each source, and a mix with stated weights has few; the table of
quotas has a row for each shard.

Defined cases: null or empty texts have size 0 and taken 0; a null source is a source of its
own; repeated rows and null ids count as often as they stand, and rows that are equal in id are
ordered by size and hash of the text; a source whose target is `cap` times its size is taken
`cap` times; texts of any length count as a whole; empty tables give empty results; other columns, of any type, don't
matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, comparable, fresh, staged, word_count

BLOCK, SEED, CAP = 8, 20240229, 3
SHARD_LEAST, SHARDS_FROM, SHARD_MOST = 64, 512, 32768
#: Copies of a row that are written from one array.
RUN = 4096
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source; sizes has source and size."""
    by = W.orderBy(F.col("source").asc_nulls_last())
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    # with the k sources capped whose caps the rising level meets first, the rest would share at level k; the level
    # grows with k as long as the next cap is below it and falls after that, so the highest one is right
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weighed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    every = W.partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("weighed")))
    t = t.withColumn("at", F.max("level").over(every))
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("at") * F.col("weight")).alias("target"))


def apportion(t: DataFrame, votes: str, seats: Column, group: list[str], tie: list[str], out: str) -> DataFrame:
    """t with the Sainte-Laguë seats of each row of a group among the group's `seats`.

    votes is a non-negative column; rows without votes get nothing. Ties of quotients go to
    the first by `tie`.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    t = t.withColumn("_all", F.sum(votes).over(g)).withColumn("_seats", seats.cast("long"))
    t = t.withColumn("_near", F.when(F.col("_all") > 0, F.floor(F.col(votes) / F.col("_all") * F.col("_seats") + 0.5)).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("_over", F.sum("_near").over(g) - F.when(F.col("_all") > 0, F.col("_seats")).otherwise(F.lit(0)))
    # a share is off by half a seat at most: quotients beyond the nearest whole are in question only for those that may move
    few = (F.ceil(F.abs(F.col("_over")) * F.col(votes) / F.col("_all")) + 1).cast("long")
    give = F.when(F.col("_over") < 0, F.transform(F.sequence(F.lit(0).cast("long"), few), lambda k: F.col(votes) / (2 * (F.col("_near") + k) + 1)))
    take = F.when(F.col("_over") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.least(few, F.col("_near"))), lambda k: F.col(votes) / (2 * (F.col("_near") - k) + 1)))
    moving = t.where((F.col("_over") != 0) & (F.col("_all") > 0) & (F.col(votes) > 0) & ((F.col("_over") < 0) | (F.col("_near") > 0)))
    moving = moving.select(*group, *tie, "_over", F.explode(F.coalesce(give, take)).alias("_q"))
    first = W.partitionBy(*(group or [F.lit(1)])).orderBy(F.when(F.col("_over") < 0, -F.col("_q")).otherwise(F.col("_q")), *[F.col(c).asc_nulls_last() for c in tie])
    moved = moving.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= F.abs("_over")).groupBy(*group, *[c for c in tie if c not in group]).agg(F.sum(-F.signum("_over")).cast("long").alias("_more"))
    keys = [*dict.fromkeys([*group, *tie])]
    m = moved.select(*[F.col(c).alias(f"_m_{c}") for c in keys], "_more")
    on = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in keys]
    kept = [c for c in t.columns if not c.startswith("_")]
    return t.join(m, on, "left").select(*kept, (F.col("_near") + F.coalesce("_more", F.lit(0))).alias(out))


def shares(docs: DataFrame, *, same: tuple[str, ...] = ("text",), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_least: int = SHARD_LEAST, seed: int = SEED) -> DataFrame:
    """What the mix takes of each set of equal rows of docs: doc_id, source, h (hash of the columns `same`), copies
    (rows of the set), size, source_size, target, passes (how often each is taken as a whole), and left: the words
    that go on to be taken from the first copy on (less than 1: none)."""
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(*[comparable(docs, c) for c in same]).alias("h"))
    sizes = staged(d.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    rows = F.count(F.lit(1))
    shards = F.greatest(F.lit(1), F.ceil(rows / SHARD_MOST), F.least(F.lit(SHARDS_FROM), F.ceil(rows / shard_least))).cast("int")
    sources = staged(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), shards.alias("shards")), "mix-sources")
    known = sources.select(F.col("source").alias("_k"), "shards")
    placed = sizes.join(known, F.col("source").eqNullSafe(F.col("_k"))).drop("_k").withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.col("shards")).cast("int")).drop("shards")
    by_shard = staged(placed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("size")), "mix-shards")
    targets = source_targets(sources.select("source", "size"), weights, cap)
    blocks = apportion(targets, "target", F.round(F.sum("target").over(W.partitionBy(F.lit(1))) / block), [], ["source"], "blocks")
    per_shard = by_shard.withColumnRenamed("source", "_s").join(blocks, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumnRenamed("size", "shard_size")
    quotas = apportion(per_shard, "shard_size", F.col("blocks"), ["source"], ["shard"], "quota")
    most = F.col("shard_size") * cap
    quotas = quotas.withColumn("words", F.when(F.col("target") >= F.col("source_size") * cap, most).otherwise(F.least(F.col("quota") * block, most)))
    quotas = staged(quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_sh"), "source_size", "target", "shard_size", "words"), "mix-quotas")
    here = W.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size", "h").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("_start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(here), F.lit(0)))
    d = laid.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_sh")), "left")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    left = F.col("words") - passes * F.col("shard_size") - F.col("_start")
    return d.select("doc_id", "source", "h", "copies", "size", "source_size", "target", passes.cast("long").alias("passes"), left.cast("long").alias("left"))


def _each(df: DataFrame, n: str, out: str) -> DataFrame:
    """A row for each number below column n, in `out`; however large n is, no array is longer than RUN."""
    run = f"{out}_run"
    runs = df.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN)))).withColumn(run, F.col(run) * RUN)
    return runs.withColumn(out, F.explode(F.sequence(F.col(run), F.least(F.col(run) + RUN, F.col(n)) - 1))).drop(run)


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of each row of docs (doc_id, text, source); how: see shares."""
    d = _each(shares(docs, **how), "copies", "copy")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def repeated(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of docs (doc_id, text, source and others) as often as the mix takes their words: whole passes, and
    once more where it takes half a row or more. Rows that are equal in all columns share what is taken of them."""
    p, cols = fresh(docs.columns), [column(c) for c in docs.columns]
    size, left = F.col("size"), F.col("left")
    full = F.greatest(F.lit(0), F.least(F.col("copies"), F.floor(left / size)))
    more = F.when((full < F.col("copies")) & (left > 0) & (2 * (left - full * size) >= size), 1).otherwise(0)
    times = F.when(size > 0, F.col("copies") * F.col("passes") + full + more).otherwise(F.lit(0)).cast("long")
    key = [p + c for c in ("i", "s", "h")]
    taken = shares(docs, same=tuple(docs.columns), **how).select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("h").alias(key[2]), F.col("copies").alias(p + "copies"), times.alias(p + "n")).where(F.col(p + "n") > 0)
    d = docs.withColumn(p + "hash", F.xxhash64(*[comparable(docs, c) for c in docs.columns]))
    d = d.join(taken, F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").cast("string").eqNullSafe(F.col(key[1])) & (F.col(p + "hash") == F.col(key[2])))
    once = d.where(F.col(p + "copies") == 1).select(*cols, p + "n")
    again = d.where(F.col(p + "copies") > 1).dropDuplicates(key).select(*cols, p + "n")
    return _each(once.union(again), p + "n", p + "k").select(*cols)
