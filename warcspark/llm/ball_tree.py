"""Exact top-k search by integer inner product: a ball tree per shard, branch and bound.

Vectors become integers floor(SCALE * x). A shard's tree is a set of flat arrays: centre,
radius and children of each node, and the range of rows below it. No row of a node scores more
than query . centre + |query| * radius, so nodes are visited by the highest bound first, and a
search ends at the first bound below the current k-th score. That score is shared: each query
first searches the cell that it lies in, and what it finds there is the floor for all others.
Cells are balls as well, so the floor rules out whole shards. Bounds get a margin for rounding
and ties are never cut, so the result is exact. Scores are taken in floating point where that
is exact, in 64-bit integers where they fit, and in unbounded integers beyond.

Scale: shards hold SHARD_ROWS distinct vectors, or half as many again, and are built where they
are dealt; trees are written to the shared folder. A task holds one tree and one block of
queries. Vectors without any structure have bounds that rule nothing out; each query then
meets all shards.

Defined cases: vectors that are null or hold null or non-finite numbers take no part, nor do
rows with a null id; zero vectors do; however large finite numbers are, they count exactly, and
only a listed score that doesn't fit 64 bits, or a component whose SCALE-fold isn't a finite
double, is an error; rows equal in id and vector count once; vectors of another dimension are
no candidates; with fewer candidates than `k` all come out; ties go to the smaller id; empty
tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import SHARD, Cells, at_home, by_shard, elsewhere, met, packed_ids, plan, ranked, vector_rows

SCALE, LEAF = 256, 48
SHARD_ROWS, K, EVERY = 8192, 5, 50
#: Beyond the numbers of 64 bits on either side, for scores that don't fit.
HIGH, LOW = 2**63, -(2**63) - 1


def below(number: int) -> float:
    """The greatest double that isn't above a whole number (below some power, that power, and without end)."""
    if abs(number) > 10**300:
        return 1e300 if number > 0 else -math.inf
    x = float(number)
    return x if x <= number else math.nextafter(x, -math.inf)


def upper(along: np.ndarray, lengths: np.ndarray, centres: np.ndarray, radii: np.ndarray, dim: int) -> np.ndarray:
    """Bounds of the scores of queries (rows) in balls (columns), with a margin for what rounding may have cost;
    along is query . centre."""
    reach = lengths[:, None] * radii[None, :]
    return along + reach + (dim + 16) * 2.0**-51 * (reach + lengths[:, None] * np.sqrt(np.square(centres).sum(1))[None, :]) + 1e-6


class Tree:
    """Nodes in the order they are made, the root first; `rows` are the points in the order of the leaves."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        self.rows = np.arange(len(x))
        centre, radius, child, span = [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = len(centre)
            if parent >= 0:
                child[parent].append(at)
            p = x[self.rows[a:b]]
            c = p.mean(0)
            far = np.sqrt(np.square(p - c).sum(1))
            centre.append(c)
            radius.append(far.max())
            child.append([])
            span.append((a, b))
            if b - a > leaf and far.max() > 0:
                one = p[far.argmax()]
                other = p[np.square(p - one).sum(1).argmax()]
                order = np.argsort(p @ (other - one), kind="stable")
                self.rows[a:b] = self.rows[a:b][order]
                mid = (a + b) // 2
                todo += [(mid, b, at), (a, mid, at)]
        self.centre, self.radius, self.span = np.array(centre), np.array(radius), np.array(span)
        self.child = np.array([c or [-1, -1] for c in child])

    def dumps(self) -> dict[str, bytes]:
        return {"head": np.array([*self.x.shape, len(self.radius)], np.int64).tobytes(), "points": self.x[self.rows].tobytes(), "rows": self.rows.tobytes(), "balls": np.column_stack([self.centre, self.radius]).tobytes(), "nodes": np.column_stack([self.child, self.span]).astype(np.int64).tobytes()}

    @classmethod
    def loads(cls, head: bytes, points: bytes, rows: bytes, balls: bytes, nodes: bytes) -> Tree:
        t = cls.__new__(cls)
        n, d, m = np.frombuffer(head, np.int64).tolist()
        t.x, t.rows = np.frombuffer(points).reshape(n, d), np.frombuffer(rows, np.int64)
        b, k = np.frombuffer(balls).reshape(m, d + 1), np.frombuffer(nodes, np.int64).reshape(m, 4)
        t.centre, t.radius, t.child, t.span = b[:, :d], b[:, d], k[:, :2], k[:, 2:]
        return t

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """(score, row) of the k best of each query, ties to the smaller row, without those below its floor.

        A loaded tree has its points in the order of the leaves.
        """
        dim = self.x.shape[1]
        high, long = np.abs(self.x).max(initial=1), np.abs(queries).max(axis=1, initial=1)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = upper(queries @ self.centre.T, np.sqrt(np.square(queries).sum(1)), self.centre, self.radius, dim)
        bound[~np.isfinite(bound)] = np.inf  # numbers whose squares are no doubles: nothing is ruled out
        child, span = self.child.tolist(), self.span.tolist()
        wide = None
        if high * long.max(initial=1) * max(1, dim) < 2.0**62:
            wide = self.x.astype(np.int64)
        out = []
        for i, q in enumerate(queries):
            best: list[tuple[int, int]] = []  # a heap with the worst on top; rows negated, so a larger row is worse
            least = floor[i] if math.isinf(floor[i]) else math.ceil(floor[i])
            most = high * long[i] * max(1, dim)
            points, q = (self.x, q) if most < 2.0**53 else (wide, q.astype(np.int64)) if wide is not None else (None, [int(v) for v in q])
            ub = bound[i]
            todo = [(-ub[0], 0)]
            while todo and -todo[0][0] >= least:
                _, node = heapq.heappop(todo)
                left, right = child[node]
                if left >= 0:
                    heapq.heappush(todo, (-ub[left], left))
                    heapq.heappush(todo, (-ub[right], right))
                    continue
                a, b = span[node]
                scores = points[a:b] @ q if points is not None else np.array([sum(int(v) * w for v, w in zip(p, q, strict=True)) for p in self.x[a:b]], object)
                for j in np.flatnonzero(scores >= least).tolist():
                    hit = (int(scores[j]), -int(self.rows[a + j]))
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                if len(best) == k:
                    least = max(least, best[0][0])
            out.append(sorted(((s, -r) for s, r in best), key=lambda x: (-x[0], x[1])))
        return out


def _integers(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.floor(v * SCALE)
    if not np.isfinite(v).all():
        raise OverflowError(f"{SCALE} times a component is no finite double")
    return v


PARTS = ["head", "points", "rows", "balls", "nodes", "ids", "starts"]


def _build(x: np.ndarray, ids: list[list[int]]) -> dict[str, bytes]:
    flat, starts = packed_ids(ids)
    return {**Tree(x).dumps(), "ids": flat, "starts": starts}


def _searched(p, asks: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """key, ids and scores of each ask in a shard of its cell, and the floor that the search leaves behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(c)[i] for c, n in enumerate(b.schema.names)}
                shard = tuple(r[n].as_py() for n in SHARD)
                if shard != at:
                    at, tree = shard, Tree.loads(*(r[n].as_py() for n in PARTS[:5]))
                    ids, starts = (np.frombuffer(r[n].as_py(), np.int64) for n in PARTS[5:])
                ask = r["asks"].as_py()
                q = np.frombuffer(b"".join(a["vec"] for a in ask)).reshape(len(ask), shard[0])
                floor = np.array([-np.inf if a["floor"] is None else a["floor"] for a in ask])
                out_ids, out_scores, left = [], [], []
                for got in tree.search(q, k + 1, floor):
                    flat = sorted(((-s, int(v)) for s, g in got for v in ids[starts[g] : starts[g + 1]]))[: k + 1]
                    out_ids.append([v for _, v in flat])
                    out_scores.append([Decimal(max(LOW, min(HIGH, -s))) for s, _ in flat])
                    left.append(below(-flat[k][0]) if len(flat) > k else None)
                yield pa.RecordBatch.from_arrays([pa.array([a["key"] for a in ask], pa.binary()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.decimal128(20, 0))), pa.array(left, pa.float64())], ["key", "ids", "scores", "floor"])

    return staged(met(p, asks, trees).select(*SHARD, *PARTS, "asks").mapInArrow(run, "key binary, ids array<long>, scores array<decimal(20,0)>, floor double"), "found")


def _may_hold(c: Cells, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which cells have a ball that reaches the floor of which query."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = upper(q @ c.centre.T, np.sqrt(np.square(q).sum(1)), c.centre, c.far, q.shape[1])
    return np.logical_or.reduceat(~(bound < floor[:, None]), c.first(), axis=1)


def top_k(df: DataFrame, *, every: int = EVERY, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best of each row of df (vec_id, embedding) whose id is divisible by `every`."""
    rows = staged(vector_rows(df, _integers), "vector-rows")
    p = plan(rows, every=every, k=k, shard_rows=shard_rows)
    trees = staged(by_shard(p.vectors, _build, PARTS), "trees")
    home = at_home(p)
    first = _searched(p, home, trees, k)
    floors = first.groupBy("key").agg(F.max("floor").alias("floor"))
    rest = _searched(p, elsewhere(p, home, floors, _may_hold), trees, k)
    out = ranked(first.select("key", "ids", "scores").unionByName(rest.select("key", "ids", "scores")), p.queries, k)
    fits = F.col("score").between(-(2**63), F.lit(2**63 - 1))
    return out.withColumn("score", F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a listed score doesn't fit 64 bits")).cast("long")))
