"""What the two vector searches share: rows of numbers in, distinct vectors, cells, routed queries, ranks out.

Equal vectors form a class: an index holds one of them, and its `k + 1` smallest ids answer
for it, which is all that a list of the k nearest can hold of them. The result is the same
as if each row stood in the index, however many rows share a vector. Query rows with equal
vectors are searched once as well.

Vectors of a dimension and a band that are too many for one shard are dealt to cells that lie
together: a tree of planes, fitted on a bounded sample, with MAX_CELLS leaves at most.
Cells that are still too large for a shard are cut into several by hash, so every row is
indexed. A query first searches the cell it lies in; with the score that its k-th best has
there as a floor, it then goes only to the cells that its operator can't rule out. Pairs of
query and cell are dealt to blocks of BLOCK_ROWS, each a task's work with one shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_unit, staged

#: Cells in all, bytes of their sample, rows of it for each cell (fewer for long vectors), and balls that describe a cell.
MAX_CELLS, SAMPLE_BYTES, CELL_SAMPLE, BALLS = 1024, 64 << 20, 128, 8
BLOCK_ROWS = 1024
SHARD = ["dim", "band", "cell", "sub"]
ROW = "vec_id long, key binary, dim int, band int, vec binary"


def _flat(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's numbers as float64; None where the row or one of its numbers is null or not finite."""
    values, offsets, valid = column.values, column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    v = values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) if len(values) else np.empty(0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(v))])
    return [v[a:b] if ok and bad[a] == bad[b] else None for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)]


def vector_rows(df: DataFrame, prepare: Callable[[np.ndarray], np.ndarray | None], band: Callable[[np.ndarray], int] = lambda v: 0) -> DataFrame:
    """vec_id, key of the vector, its dimension, band and prepared numbers, of rows that take part.

    Vectors of a dimension and a band, which should be few, share indexes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, v in zip(b.column(0).to_pylist(), _flat(b.column(1)), strict=True):
                if i is not None and v is not None and (v := prepare(v)) is not None:
                    raw = (v + 0).tobytes()
                    out.append((i, xxhash.xxh3_128_digest(raw), len(v), band(v), raw))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))], ["vec_id", "key", "dim", "band", "vec"])

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, ROW).dropDuplicates(["vec_id", "key"])


class Router:
    """Cells of the vectors of a dimension and a band, from a sample: planes that part it, down to cells and then on to
    BALLS parts of each, which tell what a cell looks like.

    All but `scale` is in units of it, so that squares of large numbers don't overflow.
    """

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.scale = float(np.abs(x).max()) or 1.0
        x = x / self.scale
        self.plane, self.cut, self.child = [], [], []
        leaves = {~0: np.arange(len(x))}  # a leaf is known by the complement of its number
        up: dict[int, tuple[int, int]] = {}  # the leaf's place below its parent
        done: set[int] = set()
        cell = {~0: 0}
        while len(leaves) < cells * BALLS and len(done) < len(leaves):
            leaf = max((k for k in leaves if k not in done), key=lambda k: (len(leaves[k]), k))
            rows = leaves[leaf]
            p = x[rows]
            one = p[np.square(p - p.mean(0)).sum(1).argmax()]
            w = p[np.square(p - one).sum(1).argmax()] - one
            at = p @ w
            line = np.sort(at)
            # in the middle half, or anywhere if that is one point, where the gap is widest: clusters stay whole
            gap = np.diff(line)
            mid = slice(len(gap) // 4, len(gap) - len(gap) // 4)
            mid = mid if len(gap) and gap[mid].max(initial=0) > 0 else slice(None)
            if not gap[mid].max(initial=0) > 0:
                done.add(leaf)
                continue
            cut = float(line[(mid.start or 0) + int(gap[mid].argmax())])
            low = at <= cut
            node, other = len(self.plane), ~len(leaves)
            self.plane.append(w)
            self.cut.append(cut)
            self.child.append([leaf, other])
            if leaf in up:
                self.child[up[leaf][0]][up[leaf][1]] = node
            leaves[leaf], leaves[other] = rows[low], rows[~low]
            up[leaf], up[other] = (node, 0), (node, 1)
            cell[other] = ~other if len(leaves) <= cells else cell[leaf]
        self.cell = np.array([cell[~c] for c in range(len(leaves))], np.int32)
        self.centre = np.array([x[leaves[~c]].mean(0) for c in range(len(leaves))])
        #: Standard deviation along the direction in which a ball is widest.
        self.spread = np.array([np.linalg.norm(x[leaves[~c]] - self.centre[c], 2) / math.sqrt(len(leaves[~c])) for c in range(len(leaves))])

    def route(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ball of each row, and its distance from the ball's centre."""
        v = v / self.scale
        ball = np.zeros(len(v), np.int32)
        todo = [(0, np.arange(len(v)))] if self.plane else []
        while todo:
            node, rows = todo.pop()
            low = v[rows] @ self.plane[node] <= self.cut[node]
            for to, part in zip(self.child[node], (rows[low], rows[~low]), strict=True):
                if to < 0:
                    ball[part] = ~to
                elif len(part):
                    todo.append((to, part))
        return ball, np.sqrt(np.square(v - self.centre[ball]).sum(1)) * self.scale


@dataclass
class Cells:
    """The balls of the routed cells of one dimension, as arrays: what a query looks at to choose cells. A cell's
    balls come one after the other."""

    band: np.ndarray
    cell: np.ndarray
    n: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    far: np.ndarray

    def first(self) -> np.ndarray:
        """Where each cell's balls begin."""
        return np.flatnonzero(np.concatenate([[True], (self.band[1:] != self.band[:-1]) | (self.cell[1:] != self.cell[:-1])]))


@dataclass
class Plan:
    """vectors: key, SHARD, vec, ids (ascending), asked. shards: dim, band, cell, subs and whether it is routed.
    queries: query_id, key. cells: by dimension."""

    vectors: DataFrame
    shards: DataFrame
    queries: DataFrame
    cells: dict[int, Cells]


def _routers(vectors: DataFrame, shard_rows: int) -> dict[tuple[int, int], Router]:
    """Of the largest groups (dimension and band), for as many cells as their vectors need and MAX_CELLS allows."""
    groups = vectors.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    large = groups.orderBy(F.col("n").desc(), "dim", "band").limit(MAX_CELLS // 2).collect()
    if not large:
        return {}
    whole, dim = sum(g.n for g in large), max(g.dim for g in large)
    most = max(2, min(MAX_CELLS, SAMPLE_BYTES // (8 * 16 * dim)))
    cells = {(g.dim, g.band): max(2, min(-(-g.n // shard_rows), most * g.n // whole)) for g in large}
    rows = max(16, min(CELL_SAMPLE, SAMPLE_BYTES // (8 * dim * sum(cells.values()))))
    share = {g: min(1.0, cells[g] * rows / n) for g, n in (((g.dim, g.band), g.n) for g in large)}
    wanted = F.create_map(*[x for g, p in share.items() for x in (F.lit(f"{g[0]} {g[1]}"), F.lit(p))])
    picked = vectors.where(hash_unit("key", seed=13) < F.coalesce(wanted[F.concat_ws(" ", "dim", "band")], F.lit(0.0))).select("dim", "band", "key", "vec").toArrow()
    by: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
    for d, b, key, vec in zip(*(picked.column(i).to_pylist() for i in range(4)), strict=True):
        by.setdefault((d, b), []).append((key, vec))
    return {g: Router(np.frombuffer(b"".join(v for _, v in sorted(found))).reshape(len(found), g[0]), cells[g]) for g, found in by.items()}


def plan(rows: DataFrame, *, every: int, k: int, shard_rows: int) -> Plan:
    """Classes of equal vectors dealt to cells and shards, and the queries (ids divisible by `every`)."""
    light = rows.select("vec_id", "key")
    small = light.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = small.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = light.where(F.col("vec_id") % every == 0)
    flag = asked.select("key").distinct().withColumn("asked", F.lit(True))
    one = rows.groupBy("key").agg(F.min(F.struct("vec_id", "dim", "band", "vec")).alias("s")).select("key", "s.dim", "s.band", "s.vec")
    found = staged(one.join(ids, "key").join(flag, "key", "left").select("key", "dim", "band", "vec", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    routers = _routers(found, shard_rows)
    shared = found.sparkSession.sparkContext.broadcast(routers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, band, vec = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("dim", "band", "vec"))
            groups: dict[tuple[int, int], list[int]] = {}
            for i, g in enumerate(zip(dim, band, strict=True)):
                groups.setdefault(g, []).append(i)
            cell, ball, far = np.zeros(len(dim), np.int32), np.full(len(dim), -1, np.int32), np.zeros(len(dim))
            for g, at in groups.items():
                if g in shared.value:
                    ball[at], far[at] = shared.value[g].route(np.frombuffer(b"".join(vec[i] for i in at)).reshape(len(at), g[0]))
                    cell[at] = shared.value[g].cell[ball[at]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(ball), pa.array(far)], [*b.schema.names, "cell", "ball", "far"])

    schema = "key binary, dim int, band int, vec binary, ids array<long>, asked boolean, cell int, ball int, far double"
    placed = staged(found.mapInArrow(assign, schema), "placed") if routers else found.withColumns({"cell": F.lit(0), "ball": F.lit(-1), "far": F.lit(0.0)})
    balls = staged(placed.groupBy("dim", "band", "cell", "ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")), "balls")
    # cells that came out a little larger than a shard stay whole
    shards = balls.groupBy("dim", "band", "cell").agg(F.ceil(F.sum("n") / (1.5 * shard_rows)).cast("int").alias("subs"), (F.max("ball") >= 0).alias("routed"))
    shards = staged(shards, "shards")
    cells: dict[int, Cells] = {}
    for r in balls.where("ball >= 0").orderBy("dim", "band", "cell", "ball").collect():  # MAX_CELLS * BALLS rows at most
        c, t = cells.setdefault(r.dim, Cells(*[[] for _ in range(6)])), routers[r.dim, r.band]
        for to, v in zip((c.band, c.cell, c.n, c.centre, c.spread, c.far), (r.band, r.cell, r.n, t.centre[r.ball] * t.scale, t.spread[r.ball] * t.scale, r.far), strict=True):
            to.append(v)
    cells = {d: Cells(*[np.array(x) for x in (c.band, c.cell, c.n, c.centre, c.spread, c.far)]) for d, c in cells.items()}
    dealt = placed.drop("far", "ball").join(shards.select("dim", "band", "cell", "subs"), ["dim", "band", "cell"]).withColumn("sub", F.pmod(F.xxhash64("key", F.lit(5)), F.col("subs")).cast("int"))
    return Plan(dealt, shards, asked.select(F.col("vec_id").alias("query_id"), "key"), cells)


def at_home(p: Plan) -> DataFrame:
    """key, dim, band, cell, vec and floor (null) of each asked vector, with the cell it lies in."""
    return p.vectors.where("asked").select("key", "dim", "band", "cell", "vec", F.lit(None).cast("double").alias("floor"))


def elsewhere(p: Plan, home: DataFrame, floors: DataFrame, choose: Callable[[Cells, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """As at_home, for all other cells of a query's dimension that can't be ruled out; floors: key and floor.

    choose tells for each of some queries (rows) and their floors which of the cells it needs. Cells that have no
    router are always asked.
    """
    shared = p.vectors.sparkSession.sparkContext.broadcast(p.cells)
    known = home.drop("floor").join(floors, "key")
    out = known.withColumnsRenamed({"band": "_b", "cell": "_c"}).join(p.shards.where("not routed").select("dim", "band", "cell"), "dim").where("band <> _b or cell <> _c").select("key", "dim", "band", "cell", "vec", "floor")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                key, dim, band, cell, vec, floor = (b.column(i).to_pylist() for i in range(6))
                rows: list[list] = [[] for _ in range(6)]
                for d in sorted(set(dim) & set(shared.value)):
                    c, at = shared.value[d], [i for i, x in enumerate(dim) if x == d]
                    q = np.frombuffer(b"".join(vec[i] for i in at)).reshape(len(at), d)
                    want = choose(c, q, np.array([-np.inf if floor[i] is None else floor[i] for i in at]))
                    bands, cells = c.band[c.first()], c.cell[c.first()]
                    want &= (bands[None, :] != np.array([band[i] for i in at])[:, None]) | (cells[None, :] != np.array([cell[i] for i in at])[:, None])
                    for j, k in zip(*np.nonzero(want), strict=True):
                        i = at[j]
                        for to, v in zip(rows, (key[i], d, bands[k], cells[k], vec[i], floor[i]), strict=True):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, b.schema, strict=True)], b.schema.names)

    if not p.cells:
        return out
    routed = known.select("key", "dim", "band", "cell", "vec", "floor").mapInArrow(pick, "key binary, dim int, band int, cell int, vec binary, floor double")
    return routed.unionByName(out)


def met(p: Plan, asks: DataFrame, index: DataFrame) -> DataFrame:
    """Blocks of asks (array of key, vec and floor) with each shard of their cell: index's rows, and `asks`."""
    cell = ["dim", "band", "cell"]
    asks = staged(asks, "asks")
    blocks = staged(asks.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).join(p.shards.select(*cell, "subs"), cell), "blocks")
    # a cell may hold a third of all asks: counted before, they are dealt by cell and a hash at once
    salted = asks.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(64)).cast("int"))
    many = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    dealt = salted.join(many, [*cell, "salt"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int"))
    lists = dealt.groupBy(*cell, "block").agg(F.collect_list(F.struct("key", "vec", "floor")).alias("asks"), F.max("subs").alias("subs")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    copies = index.join(blocks.drop("subs"), cell).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return copies.join(lists, [*SHARD, "block"]).drop("block").sortWithinPartitions(*SHARD)


def by_shard(vectors: DataFrame, build: Callable[[np.ndarray, list[list[int]]], dict[str, bytes]], parts: list[str]) -> DataFrame:
    """An index for each shard, with the named binary parts that build makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vecs, ids = None, [], []

        def made() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(vecs)).reshape(len(vecs), at[0])
            blob = build(x, ids)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in at), *(pa.array([blob[p]], pa.binary()) for p in parts)], [*SHARD, *parts])

        for b in batches:
            for *shard, vec, own in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if at is not None and at != shard:
                    yield made()
                    vecs, ids = [], []
                at = shard
                vecs.append(vec)
                ids.append(own)
        if at is not None:
            yield made()

    dealt = vectors.repartition(*SHARD).sortWithinPartitions(*SHARD, F.col("ids")[0])
    return dealt.select(*SHARD, "vec", "ids").mapInArrow(run, ", ".join([*(f"{c} int" for c in SHARD), *(f"{p} binary" for p in parts)]))


def packed_ids(ids: list[list[int]]) -> tuple[bytes, bytes]:
    """All ids one after the other, and where each row's begin."""
    return np.fromiter((i for x in ids for i in x), np.int64).tobytes(), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64).tobytes()


def ranked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score; found: key and arrays ids and scores, of each shard."""
    flat = found.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("key", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    best = W.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    top = flat.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    own = W.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    out = queries.join(top, "key").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
