import numpy as np
import pytest
from pyspark.sql import functions as F

from warcspark.llm import ball_tree, hnsw, vectors


def _frame(spark, rows):
    rows = [(i, v if v is None else [c if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("key", F.lit("clash"))


def _rows(n, d, seed, scale=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (r.lognormal(0, 0.7, (n, 1)) if scale else 1)
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


def brute(rows, every, k, prepare):
    """(query, rank) -> (vec_id, score), ties to the smaller id."""
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            p = prepare(np.array(v, float))
            if p is not None:
                seen[i, tuple(p)] = (i, p)
    out = {}
    for q, p in seen.values():
        if q % every == 0:
            s = sorted((-float(p @ v), i) for i, v in seen.values() if i != q and len(v) == len(p))
            out |= {(q, r + 1): (i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


def floors(v):
    return np.floor(v * 256)


@pytest.mark.parametrize("shard_rows", [7, 64, 1000])
def test_ball_tree_is_exact(spark, shard_rows):
    rows = _rows(300, 6, 1) + [(1000 + i, [0.5] * 6) for i in range(40)] + [(2000, [0.0] * 6), (2050, None), (2100, [1.0, None, 1, 1, 1, 1]), (2150, [float("nan")] + [1.0] * 5), (None, [1.0] * 6), (3000, [1.0, 2.0]), (3050, [2.0, 1.0]), (1000, [0.5] * 6)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ball_tree.top_k(_frame(spark, rows), every=50, k=5, shard_rows=shard_rows).collect()}
    assert got == brute(rows, 50, 5, floors)


def test_ball_tree_keeps_large_components(spark):
    """Integers beyond 2**26, beyond 2**53 in their products, and beyond 64 bits in products that aren't listed."""
    rng = np.random.default_rng(9)
    rows = [(i, [*(rng.normal(size=2) * 10.0 ** (i % 7)).astype(np.float32).tolist(), 0.0]) for i in range(120)]
    rows += [(1000, [300000.0, 1.0, 0.0]), (1050, [1e6, -1e6, 0.0]), (1100, [3e7, 0.0, 0.0]), (1151, [0.0, 0.0, 2e30]), (1152, [1.0, 5.0, -3e30])]
    ints = {i: [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v] for i, v in rows}
    want = {}
    for q in (0, 50, 100, 1000, 1050, 1100):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, r + 1): (i, -x) for r, (x, i) in enumerate(s)}
    for shard_rows in (16, 1000):
        got = ball_tree.top_k(_frame(spark, rows), every=50, k=5, shard_rows=shard_rows).collect()
        assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want
    with pytest.raises(Exception, match="64 bits"):
        ball_tree.top_k(_frame(spark, [(0, [1e18, 0.0]), (1, [1e18, 1.0])])).collect()
    own = ball_tree.top_k(_frame(spark, [(0, [1e12, 0.0]), (1, [1.0, 1.0])])).collect()
    assert [(r.vec_id, r.score) for r in own] == [(1, 256 * int(256 * np.float64(np.float32(1e12))))]


def _clusters(n, d, seed, groups=40, unit=False):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, d)) * 3
    x = c[r.integers(0, groups, n) * (r.random(n) > 0.3)] + r.normal(size=(n, d)) * 0.4  # the first holds a third of all
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("module", [ball_tree, hnsw])
def test_few_cells_are_asked_where_vectors_cluster(spark, module, monkeypatch):
    rows, pairs = _clusters(3000, 16, 6, unit=module is hnsw), []
    kept = module.elsewhere
    monkeypatch.setattr(module, "elsewhere", lambda p, *a: pairs.append((kept(p, *a).count(), p.shards.count())) or kept(p, *a))
    if module is ball_tree:
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ball_tree.top_k(_frame(spark, rows), shard_rows=100).collect()}
        assert got == brute(rows, 50, 5, floors)
    else:
        want = brute(rows, 20, 20, lambda v: v)
        got = {(r.query_id, r.rank): r.vec_id for r in hnsw.nearest(_frame(spark, rows), shard_rows=100).collect()}
        by = {}
        for (q, _), (i, _) in want.items():
            by.setdefault(q, set()).add(i)
        assert set(got) == set(want) and sum(i in by[q] for (q, _), i in got.items()) >= 0.95 * len(want)
    queries = 60 if module is ball_tree else 150
    asked, shards = pairs[0]
    assert shards >= 20 and asked < 0.5 * queries * shards, (asked, queries, shards)


def test_router_cells():
    x = np.random.default_rng(1).normal(size=(1000, 5))
    r = vectors.Router(x, 16)
    ball, far = r.route(x)
    cell = r.cell[ball]
    assert sorted(set(cell.tolist())) == list(range(16)) and np.bincount(cell).max() <= 150 and len(r.centre) == 16 * vectors.BALLS
    assert np.allclose(far, np.sqrt(np.square(x - r.centre[ball] * r.scale).sum(1)))
    same = vectors.Router(np.ones((9, 2)), 4)
    assert len(same.centre) == 1 and same.route(np.ones((3, 2)))[0].tolist() == [0, 0, 0]
    two = vectors.Router(np.array([[1.0, 0]] * 9 + [[0.0, 1]]), 4)
    assert len(two.centre) == 2 and two.spread.tolist() == [0, 0]


def test_ball_tree_visits_few_leaves():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 3)) * 256)
    t = ball_tree.Tree.loads(**{k: v for k, v in ball_tree.Tree(x).dumps().items()})
    q = x[:20]
    got = t.search(q, 5, np.full(20, -np.inf))
    for one, hits in zip(q, got, strict=True):
        s = (x @ one).astype(int)
        assert hits == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(len(s)), -s))[:5]]


def test_empty_tables(spark):
    df = _frame(spark, [(1, [1.0, 2.0])])
    for f in (ball_tree.top_k, hnsw.nearest):
        assert f(df.limit(0)).count() == 0
        assert f(df).count() == 0


@pytest.mark.parametrize("scale", [False, True])
def test_hnsw_recall(spark, scale):
    rows = _rows(1500, 24, 3, scale)
    want = brute(rows, 20, 20, lambda v: v)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in hnsw.nearest(_frame(spark, rows), shard_rows=400).collect()}
    assert set(got) == set(want)
    by = {}
    for (q, _), (i, _) in want.items():
        by.setdefault(q, set()).add(i)
    hits = sum(i in by[q] for (q, _), (i, _) in got.items())
    assert hits / len(want) >= 0.95
    x = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - x[q] @ x[i]) < 1e-9 for (q, _), (i, s) in got.items())
    assert all(got[q, r][1] >= got[q, r + 1][1] for q, r in got if (q, r + 1) in got)


def test_hnsw_copies_and_odd_rows(spark):
    rows = _rows(30, 4, 4) + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(200, [0.0] * 4), (220, None), (240, [1.0, None, 0, 0]), (260, [float("inf"), 0, 0, 0]), (None, [1.0] * 4), (280, [1.0])]
    usable = lambda v: v if v.any() else None
    got = {(r.query_id, r.rank): r.vec_id for r in hnsw.nearest(_frame(spark, rows)).collect()}
    assert got == {k: v for k, (v, _) in brute(rows, 20, 20, usable).items()}


def test_graph_survives_writing():
    x = np.random.default_rng(0).normal(size=(500, 8))
    g = hnsw.Graph(x)
    h = hnsw.Graph.loads(**g.dumps())
    assert (g.search(x[:9], 5) == h.search(x[:9], 5)).all() and len(h.layers) == len(g.layers) > 1
