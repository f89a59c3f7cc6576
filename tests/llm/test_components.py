import random

from warcspark.llm import components as C


def test_stars_take_no_further_round(spark, monkeypatch):
    """Links that are stars are told as such, without a round that changes nothing; others settle on the smallest node."""
    rounds, real = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: (rounds.append(name), real(df, name))[1])
    stars = [(9, 1), (1, 8), (7, 1), (5, 2), (5, 2), (3, 3)]
    got = {(r.node, r.component) for r in C.connected_components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {(9, 1), (8, 1), (7, 1), (1, 1), (5, 2), (2, 2)} and len(rounds) == 1
    rng = random.Random(4)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    top = {n: n for p in links for n in p}
    for _ in range(40):
        for u, v in links:
            top[u] = top[v] = min(top[u], top[v])
    want = {(n, c) for n, c in top.items() if any(n in p and p[0] != p[1] for p in links)}
    assert {(r.node, r.component) for r in C.connected_components(spark.createDataFrame(links, "u long, v long")).collect()} == want
