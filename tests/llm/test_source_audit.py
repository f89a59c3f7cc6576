import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from warcspark.llm import source_audit as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + 10**9 * (n + 2) // (all_ + 2 * len(kept))
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["Alpha", "béta", "gamma", "ZÉ", "ÀÀ", "d'or", "e1f", "漢字", "x", "ı", "\U0001f600", "é"] + [f"w{chr(97 + i)}" for i in range(20)]
    out = [(None, "en", "a"), ("", None, None), ("... 123", "xx", "only"), ("one two", "yy", "p"), ("one two", "yy", "q"), (None, None, "s"), ("Alpha " * 50_000, "en", "b")]
    for k in range(400):
        out.append((" ".join(rng.choice(words[: 8 + k % 24]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "b", "c", "É", None])))
    return out + out[20:60]


@pytest.mark.parametrize("how", [{}, {"cells": 20, "part": 7}, {"held": 1, "least": 1, "top": 3}])
def test_like_brute_force(spark, rows, how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for c in ("n", "term", "docs", "cells", "salt", "_lang", "item", "value", "rank", "part"):
        df = df.withColumn(c, F.lit("clash"))
    got = [tuple(r) for r in S.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(map(str, got)) == brute(rows, how.get("least", 10), how.get("top", 10))
    assert S.audit(df.limit(0)).collect() == []


def test_shares_are_exact_however_large():
    import numpy as np

    for counts in ([0, 5, 10**6], [10**10, 3, 10**17]):
        got = S.shares(np.array(counts), np.array(sum(counts)), 3)
        assert got.tolist() == [1 + 10**9 * (c + 2) // (sum(counts) + 6) for c in counts]


def test_a_task_holds_few_stripes():
    import pyarrow as pa

    s, most, out = S.Stripes(), 0, []
    for k in range(50):
        s.add(["en"] * 4, ["a", "b", "a", "c"], pa.array([f"{chr(97 + k % 26)}z{chr(97 + j)} common" for j in range(4)]))
        if s.full(40, 1 << 20):
            out += list(s.take())
        most = max(most, s.cells)
    out += list(s.take())
    assert most < 60
    total = Counter()
    for b in out:
        for t, cells in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            total[t] += sum(c["n"] for c in cells)
    assert total["common"] == 200 and total[None] == 200
