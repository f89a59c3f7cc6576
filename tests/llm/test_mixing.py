import random
from fractions import Fraction

from pyspark.sql import functions as F

from warcspark.llm import mixing as M


def targets(sizes, weights=(1, 2, 3), cap=3):
    """By rounds, as stated: what exceeds a cap is shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def sainte_lague(votes, seats):
    """One seat after the other, to the highest quotient; ties to the first."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = max(votes, key=lambda s: (Fraction(votes[s]) / (2 * got[s] + 1), [-ord(c) for c in s]))
        got[best] += 1
    return got


def _docs(seed, sources, n=200):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choices(sources, [2 ** -k for k in range(len(sources))])[0]) for i in range(n)]


def test_targets_and_taken(spark):
    for seed, sources in ((1, ["a", "b", "c", "d", None]), (2, ["x"]), (3, ["Z", "a", "É", "10", "9", "b", None])):
        rows = _docs(seed, sources)
        got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        want, taken = targets(sizes), {}
        assert len(got) == len(rows)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6 * max(1, r.target)
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for s, n in taken.items():
            assert abs(n - want[s]) <= 6 * M.BLOCK, (s, n, want[s])


def test_apportionment_is_by_highest_quotients(spark):
    for seed in range(4):
        rng = random.Random(seed)
        votes = {f"s{i}": rng.choice([0, 1, 7, 100, 1000, 1000]) for i in range(rng.randint(1, 9))}
        for seats in (0, 1, 5, 17, 40):
            t = spark.createDataFrame([(k, float(v)) for k, v in votes.items()], "source string, votes double")
            got = {r.source: r.seats for r in M.apportion(t, "votes", F.lit(seats), [], ["source"], "seats").collect()}
            assert got == sainte_lague(votes, seats), (votes, seats)


def test_reruns_agree(spark):
    df = spark.createDataFrame(_docs(4, ["a", "b", "c"]), "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, M.mix(x).collect())) for x in (df, df.repartition(7)))
    assert one == two


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y \t z", "a"), (3, "x y \t z", "a"), (None, "q " * 100000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    got = M.mix(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 0), ("2", 0), ("3", 3), ("3", 3), ("None", 100000)]
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert M.mix(df.limit(0)).count() == 0
    empty = M.mix(df.where("doc_id < 3")).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0), (0, 0.0)]


def test_only_native_plans(spark):
    df = spark.createDataFrame(_docs(4, ["a"]), "doc_id long, text string, source string")
    plan = M.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_small_documents_of_a_capped_source(spark):
    """About one document of one word a shard, with the production numbers of shards: nothing is clipped."""
    rows = [(i, "w", "a") for i in range(500)] + [(1000 + i, "w " * 40, "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (1, M.SHARD_LEAST):
        got = M.mix(df, weights=(1, 1), shard_least=least).collect()
        want = targets({"a": 500, "b": 16000}, (1, 1))
        for s in "ab":
            assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 3 * M.BLOCK


def test_equal_rows_and_null_ids(spark):
    rows = [(None, f"w{i % 3} x y", "a", i % 3) for i in range(300)] + [(7, "same text here", "a", 0)] * 5000 + [(i, "b c d e", "b", 0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    want = targets({"a": 15900, "b": 400})
    assert all(abs(taken[s] - want[s]) <= 6 * M.BLOCK for s in "ab") and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df.repartition(5)).collect()))
    out = M.repeated(df).collect()
    times = sum(int(r.taken / r.size + 0.5) for r in got)
    assert len(out) == times and {tuple(r) for r in out} <= {tuple(r) for r in df.distinct().collect()}
    assert M._each(spark.range(1).selectExpr("10000L as n"), "n", "k").agg(F.count("k"), F.min("k"), F.max("k")).first() == (10000, 0, 9999)
    assert M.repeated(df.limit(0)).count() == 0
