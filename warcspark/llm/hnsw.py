"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Nearness is the inner product. A graph holds vectors of like length, and they get one more
coordinate that makes them equally long, so the graph is one of a true metric; a query gets a
zero there. Layer
l holds each vector with a chance of LINKS ** -l; a layer is a flat array of neighbours, a row
of LINKS (twice as many on the ground) for each vector, filled with -1. Vectors enter in
batches: each goes down the layers and searches those it stands in for the EF_BUILD nearest found of the graph so far;
those of its own batch, which aren't linked yet, join them by a product within the batch. Of these candidates diverse ones are kept: one that is nearer to one
already kept than to the vector itself comes last. Rows that links back overfill are pruned by
the same rule. Queries search the layers with arrays in place of queues, many at once.

A query first searches the graph of the cell it lies in, then those of other cells that may
hold a share of its k nearest: with the k-th score found as a floor, the number of a cell's
vectors above it is estimated from centre, spread and size of its parts, and the cells left out
are expected to hold MISS of the k together at most. Scores are computed anew in double
precision on the original vectors and merged by rank.

Scale: shards hold SHARD_ROWS distinct vectors, or half as many again, and are built where they
are dealt; graphs are written to the shared folder, so a lost executor costs its shards only. A
task holds one graph and one block of queries. Vectors without any structure have their nearest
in all cells alike; each query then meets all shards.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers take no part,
nor do rows with a null id; rows equal in id and vector count once; vectors of another
dimension are no candidates; with fewer candidates than `k` all that were found come out; empty
tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import SHARD, Cells, at_home, by_shard, elsewhere, met, packed_ids, plan, ranked, vector_rows

LINKS, EF_BUILD, WIDTH, BATCH, SEED = 24, 96, 4, 256, 3
#: Lengths of the vectors of a graph differ by this factor at most.
LENGTH_BAND = 1.2
SHARD_ROWS, K, EVERY = 8192, 20, 20
#: Share of the k nearest that the cells left out may hold.
MISS = 0.01
#: Candidates that a search keeps in its own cell, whose graph holds the query itself, and in others.
EF_SEARCH, EF_NEXT = 96, 128
#: Queries that are searched at once.
AT_ONCE = 256


def beam(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef best found for each query (-1 where fewer) and their scores, best first."""
    n, ef = len(q), max(ef, WIDTH, entry.shape[1])
    rows = np.arange(n)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for -1
    ids = np.full((n, ef), -1, np.int32)
    score = np.full((n, ef), -np.inf, np.float32)
    open_ = np.zeros((n, ef), bool)
    ids[:, : entry.shape[1]] = entry
    score[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bd,bkd->bk", q, x[entry]), -np.inf)
    open_[:, : entry.shape[1]] = entry >= 0
    seen[rows[:, None], entry] = True
    seen[:, -1] = True
    live = rows
    while len(live):
        now = np.where(open_[live], score[live], -np.inf)
        pick = np.argpartition(-now, WIDTH - 1, axis=1)[:, :WIDTH]
        real = np.take_along_axis(now, pick, 1) > -np.inf
        going = real.any(1)
        live, pick, real = live[going], pick[going], real[going]
        if not len(live):
            break
        open_[live[:, None], pick] = False
        nodes = np.where(real, ids[live[:, None], pick], -1)
        nxt = np.where(nodes[:, :, None] >= 0, nbr[nodes], -1).reshape(len(live), -1)
        nxt.sort(axis=1)
        nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = -1
        nxt[seen[live[:, None], nxt]] = -1
        seen[live[:, None], nxt] = True
        width = int((nxt >= 0).sum(1).max(initial=0))
        if not width:
            continue
        nxt = -np.sort(-nxt, axis=1)[:, :width]
        s = np.where(nxt >= 0, np.matmul(x[nxt], q[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        every = np.concatenate([score[live], s], 1)
        keep = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
        score[live] = np.take_along_axis(every, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], nxt], 1), keep, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], nxt >= 0], 1), keep, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def diverse(x: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (best first, -1 for none): diverse ones before the rest."""
    n, c = ids.shape
    v = x[ids]
    close = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((n, c), bool)
    for k in range(c):
        near = np.where(kept, close[:, k, :], -np.inf).max(1)
        kept[:, k] = (ids[:, k] >= 0) & (score[:, k] > near) & (kept.sum(1) < most)
    order = np.argsort(np.where(ids < 0, 2, 1 - kept), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    def __init__(self, x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = SEED) -> None:
        """x: float64 rows, none zero."""
        x = x / np.abs(x).max()
        long = (x * x).sum(1)
        self.x = np.column_stack([x, np.sqrt(np.maximum(long.max() - long, 0))]).astype(np.float32) / np.float32(np.sqrt(long.max()))
        n = len(x)
        level = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 8)
        order = np.argsort(-level, kind="stable")
        self.entry = int(order[0])
        self.layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(level.max()) + 1)]
        done = 1
        while done < n:
            end = min(n, done + max(8, min(BATCH, done // 2)))
            self._enter(order[done:end], level[order[done:end]], ef)
            done = end

    def _enter(self, batch: np.ndarray, level: np.ndarray, ef: int) -> None:
        """Links a batch, which stands in order of falling levels, into all of its layers, from above."""
        q = self.x[batch]
        entry = np.full((len(batch), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            here = int(np.searchsorted(-level, -k, side="right"))  # so many of the batch stand in this layer
            ids, score = beam(self.x, self.layers[k], q, entry, ef if here else WIDTH)
            entry = ids[:, : max(WIDTH, ef // 8)]
            if not here:
                continue
            most = self.layers[k].shape[1]
            own = q[:here] @ q[:here].T
            np.fill_diagonal(own, -np.inf)
            ids = np.concatenate([ids[:here], np.where(np.eye(here, dtype=bool), -1, batch[None, :here])], 1)
            score = np.where(ids >= 0, np.concatenate([score[:here], own], 1), -np.inf)
            near = np.argsort(-score, axis=1, kind="stable")[:, : 2 * most]
            chosen = diverse(self.x, np.take_along_axis(ids, near, 1).astype(np.int32), np.take_along_axis(score, near, 1), most // 2 if k == 0 else most)
            self.layers[k][batch[:here], : chosen.shape[1]] = chosen
            self._back(k, batch[:here], chosen)

    def _back(self, k: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Links back to nodes; rows that overflow keep diverse ones."""
        to, frm = chosen.ravel(), np.repeat(nodes, chosen.shape[1]).astype(np.int32)
        order = np.argsort(to[to >= 0], kind="stable")
        to, frm = to[to >= 0][order], frm[to >= 0][order]
        if not len(to):
            return
        rows, first, count = np.unique(to, return_index=True, return_counts=True)
        new = np.full((len(rows), count.max()), -1, np.int32)
        new[np.repeat(np.arange(len(rows)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
        nbr = self.layers[k]
        width = nbr.shape[1]
        every = np.concatenate([nbr[rows], new], 1)
        every.sort(1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        every = -np.sort(-every, 1)
        over = every[:, width] >= 0
        nbr[rows[~over]] = every[~over, :width]
        for at in range(0, int(over.sum()), 1024):
            some = rows[over][at : at + 1024]
            ids = every[over][at : at + 1024]
            s = np.where(ids >= 0, np.matmul(self.x[ids], self.x[some][:, :, None])[:, :, 0], -np.inf)
            best = np.argsort(-s, axis=1, kind="stable")[:, : 2 * width]
            nbr[some] = diverse(self.x, np.take_along_axis(ids, best, 1), np.take_along_axis(s, best, 1), width)

    def dumps(self) -> dict[str, bytes]:
        head = np.array([len(self.x), self.x.shape[1], self.entry, *[x.shape[1] for x in self.layers]], np.int64)
        return {"head": head.tobytes(), "points": self.x.tobytes(), "neighbours": b"".join(x.tobytes() for x in self.layers)}

    @classmethod
    def loads(cls, head: bytes, points: bytes, neighbours: bytes) -> Graph:
        g = cls.__new__(cls)
        n, d, g.entry, *widths = np.frombuffer(head, np.int64).tolist()
        g.x = np.frombuffer(points, np.float32).reshape(n, d)
        flat, ends = np.frombuffer(neighbours, np.int32), np.cumsum([0, *(n * w for w in widths)])
        g.layers = [flat[a:b].reshape(n, w) for a, b, w in zip(ends, ends[1:], widths, strict=False)]
        return g

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Rows of the k nearest found to each query, -1 where fewer; best first by the graph's own scores."""
        q = q / np.maximum(np.abs(q).max(axis=1, keepdims=True), np.finfo(float).tiny)  # so that no length is beyond single precision
        q = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        entry = np.full((len(q), 1), self.entry, np.int32)
        for layer in reversed(self.layers[1:]):
            entry = beam(self.x, layer, q, entry, WIDTH)[0][:, :WIDTH]
        return beam(self.x, self.layers[0], q, entry, max(ef, k))[0][:, :k]

    def search_all(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        return np.concatenate([self.search(q[at : at + AT_ONCE], k, ef) for at in range(0, len(q), AT_ONCE)])


def _usable(v: np.ndarray) -> np.ndarray | None:
    return v if np.any(v) else None


def _band(v: np.ndarray) -> int:
    top = np.abs(v).max()
    return int(np.floor((np.log(top) + 0.5 * np.log(np.square(v / top).sum())) / np.log(LENGTH_BAND) + 0.5))


PARTS = ["head", "points", "neighbours", "original", "ids", "starts"]


def _build(x: np.ndarray, ids: list[list[int]]) -> dict[str, bytes]:
    flat, starts = packed_ids(ids)
    return {**Graph(x).dumps(), "original": x.tobytes(), "ids": flat, "starts": starts}


def _searched(p, asks: DataFrame, graphs: DataFrame, k: int, ef: int) -> DataFrame:
    """key, ids and scores of each ask in a shard of its cell, and its k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(c)[i] for c, n in enumerate(b.schema.names)}
                shard = tuple(r[n].as_py() for n in SHARD)
                if shard != at:
                    at, graph = shard, Graph.loads(*(r[n].as_py() for n in PARTS[:3]))
                    x = np.frombuffer(r["original"].as_py()).reshape(len(graph.x), shard[0])
                    ids, starts = (np.frombuffer(r[n].as_py(), np.int64) for n in PARTS[4:])
                asks = r["asks"].as_py()
                q = np.frombuffer(b"".join(a["vec"] for a in asks)).reshape(len(asks), shard[0])
                out_ids, out_scores, left = [], [], []
                for one, got in zip(q, graph.search_all(q, k + 1, ef), strict=True):
                    got = got[got >= 0]
                    s = np.einsum("nd,d->n", x[got], one)
                    mine = np.concatenate([ids[starts[g] : starts[g + 1]] for g in got]) if len(got) else np.empty(0, np.int64)
                    s = np.repeat(s, starts[got + 1] - starts[got])
                    best = np.lexsort((mine, -s))[: k + 1]
                    out_ids.append(mine[best])
                    out_scores.append(s[best])
                    left.append(float(s[best[k]]) if len(best) > k else None)
                yield pa.RecordBatch.from_arrays([pa.array([a["key"] for a in asks], pa.binary()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64())), pa.array(left, pa.float64())], ["key", "ids", "scores", "floor"])

    found = met(p, asks, graphs).select(*SHARD, *PARTS, "asks").mapInArrow(run, "key binary, ids array<long>, scores array<double>, floor double")
    return staged(found, "found")


#: The share of a normal law beyond some standard deviations.
_DEVIATIONS = np.linspace(-8, 8, 1601)
_TAIL = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in _DEVIATIONS])


def _worth(k: int):
    def choose(c: Cells, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which cells each query needs: all but those that together are expected to hold MISS of its k nearest."""
        wide = np.maximum(c.spread[None, :] * np.sqrt(np.square(q).sum(1))[:, None], 1e-300)
        away = np.clip((floor[:, None] - q @ c.centre.T) / wide, -40, 40)
        hits = np.add.reduceat(c.n[None, :] * np.interp(away, _DEVIATIONS, _TAIL), c.first(), axis=1)
        order = np.argsort(hits, axis=1, kind="stable")
        want = np.cumsum(np.take_along_axis(hits, order, 1), 1) > MISS * k
        out = np.empty_like(want)
        np.put_along_axis(out, order, want, 1)
        return out

    return choose


def nearest(df: DataFrame, *, every: int = EVERY, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest found of each row of df (vec_id, embedding) whose id is divisible by `every`."""
    rows = staged(vector_rows(df, _usable, _band), "vector-rows")
    p = plan(rows, every=every, k=k, shard_rows=shard_rows)
    graphs = staged(by_shard(p.vectors, _build, PARTS), "graphs")
    home = at_home(p)
    first = _searched(p, home, graphs, k, EF_SEARCH)
    floors = first.groupBy("key").agg(F.max("floor").alias("floor"))
    rest = _searched(p, elsewhere(p, home, floors, _worth(k)), graphs, k, EF_NEXT)
    return ranked(first.select("key", "ids", "scores").unionByName(rest.select("key", "ids", "scores")), p.queries, k)
