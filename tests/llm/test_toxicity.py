import itertools
import random

from pyspark.sql import functions as F

from warcspark.llm import toxicity as X


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_machine_against_distances():
    terms, stems = ["idiot", "moron", "scum", "trash", "loser"], ["veju"]
    m = X.Machine(terms, stems)
    rng = random.Random(3)
    words = ["idoit", "idit", "idiots", "xidiot", "scam", "scum", "vejuté", "vejx", "trsah", "", "a"]
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "r", "mo"])
        words.append("".join(w))
    for w in words:
        near = [t for t in terms if len(t) >= X.FUZZY_FROM and distance(w, t) <= 1]
        want = "exact" if w in terms else "stem" if w.startswith("veju") else "near" if near else None
        got = m.match(w)
        assert (got and got[0]) == want, w
        if want == "near":
            assert got[1] in near


def _texts():
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron,", "Worthless"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_learned_lexicon_and_scores():
    texts, toxic = _texts()
    m = X.fit(texts, toxic)
    assert set(m.terms) == {"idiot", "moron", "worthless"}
    s = m.scores(__import__("numpy").array([m.features(t) for t in texts]))
    assert all((p >= 0.5) == bool(y) for p, y in zip(s, toxic, strict=True))
    odd = m.scores(__import__("numpy").array([m.features("you idoit and mooron w1 w2 wothless"), m.features(None), m.features("")]))
    assert odd[0] >= 0.5 > odd[1] == odd[2]


def test_quotation_is_told_from_abuse():
    words = 'they said "you idiot" to him and that was all of it for the day'.split()
    assert X.quoted(words, words.index('idiot"'))
    assert not X.quoted("you are an idiot and that is all there is".split(), 3)


def test_copies_lend_no_weight():
    texts = ["rare unusual phrase idiot here"] * 40 + [f"w{i} idiot w{i + 1} x{i}" for i in range(30)] + [f"w{i} fine w{i + 1} y{i}" for i in range(200)]
    terms, _ = X.learn_lexicon(texts, [1] * 70 + [0] * 200)
    assert terms == ["idiot"]


def test_defined_cases(spark):
    texts, toxic = _texts()
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (900, None), (901, ""), (902, "idiot " * 50000), (902, "idiot moron"), (None, "w1")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*((i, y) for i, y in enumerate(toxic)), (3, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    m = X.fit_documents(docs, labels)
    got = X.score(docs.select("doc_id", "text"), m).collect()
    assert len(got) == len(texts) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    at = {r.doc_id: r.predicted for r in got}
    assert at[900] == at[901] == 0 and at[902] == 1
    assert all(at[i] == y for i, y in enumerate(toxic))
    none = X.fit_documents(docs, labels.limit(0))
    assert {r.score for r in X.score(docs.select("doc_id", "text"), none).collect()} == {X.fit([], []).scores(__import__("numpy").array([[1.0, 0, 0, 0, 0]]))[0]}
    assert X.score(docs.select("doc_id", "text").limit(0), m).count() == 0


def test_misspelled_stems_against_distances():
    terms, stems = ["idiot", "idiots", "veju"], ["idio", "achlich", "reeux"]
    m = X.Machine(terms, stems)
    rng = random.Random(4)
    words = ["idoit", "idoits", "idiotic", "aclhichkeit", "achlixhen", "chlichen", "achlicien", "reuex", "reexen", "ree", ""]
    for _ in range(3000):
        w = list(rng.choice(terms + stems) + rng.choice(["", "en", "keit", "s"]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 2)] = rng.choice(["", "a", "c", "ux", "oi"])
        words.append("".join(w))
    for w in words:
        near = {t for t in terms if len(t) >= X.FUZZY_FROM and distance(w, t) <= 1}
        near |= {s for s in stems if len(s) >= X.FUZZY_FROM and any(distance(w[:k], s) <= 1 for k in range(1, len(w) + 1))}
        want = "exact" if w in terms else "stem" if w.startswith(tuple(stems)) else "near" if near else None
        got = m.match(w)
        assert (got and got[0]) == want, w
        if want == "near":
            assert got[1] in near
    ordinary = X.Machine(terms, stems, frozenset(["achlixh*"]))
    assert ordinary.match("achlixhen") is None and ordinary.match("achlxichen") == ("near", "achlich")


def test_stems_dont_switch_misspellings_off():
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(plain) for _ in range(20)) for _ in range(300)]
    texts = [f"{t} {('idiot', 'idiots', 'idiotic')[i % 3]} {t[::-1]}" if i % 4 == 0 else t for i, t in enumerate(texts)]
    m = X.fit(texts, [int(i % 4 == 0) for i in range(300)])
    assert {"idiot", "idiots", "idiotic"} <= set(m.terms) and m.stems == ["idio"]
    assert [m.kind(w) for w in ("idoit", "idotic", "idiotism", "w7")] == [2, 2, 3, 0]


def test_sample_is_bounded_before_the_driver(spark, monkeypatch):
    monkeypatch.setattr(X, "FIT_CHARS", 4000)
    monkeypatch.setattr(X, "FIT_CLEAN", 20)
    seen = []
    monkeypatch.setattr(X, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    docs = spark.range(200_000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(100, "y" * 5000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(100, 1)], "doc_id long, toxic int")
    X.fit_documents(docs, labels)
    texts, toxic = seen[0]
    assert len(texts) <= 40 and sum(toxic) <= 10 < len(toxic) and sum(map(len, texts)) <= 4000 and not any("yy" in t for t in texts)


def one_edit(a, b):
    """Whether the distance is at most 1, letter by letter."""
    if len(a) == len(b):
        off = [i for i in range(len(a)) if a[i] != b[i]]
        return len(off) < 2 or (len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _hits(model, words, known={}):
    """Kinds of the words by comparison with every term and stem."""
    out = []
    for w in words:
        p = X.plain(w)
        if p not in known:
            near = [t for t in model.terms if len(t) >= X.FUZZY_FROM and one_edit(p, t)]
            ends = [(k, s) for s in model.stems if len(s) >= X.FUZZY_FROM for k in (len(s) - 1, len(s), len(s) + 1) if k <= len(p) and one_edit(p[:k], s)]
            kind = 1 if p in model.terms else 3 if p.startswith(tuple(model.stems)) and model.stems else 0
            if not kind and near:
                kind = 2 * (p not in model.exceptions)
            elif not kind and ends:
                kind = 2 * (p[: min(ends)[0]] + "*" not in model.exceptions)
            known[p] = kind if p else 0
        out.append(known[p])
    return out


def _in_quotes(words, i):
    """Told word by word: a word of reporting nearby, or an opening mark before that nothing closes before the word."""
    lo, hi = max(0, i - X.WINDOW), min(len(words), i + X.WINDOW + 1)
    for j in [*range(lo, i), *range(i + 1, min(hi, i + 3))]:
        if X.plain(words[j]) in X.REPORTING:
            return True
    opens = [j for j in range(lo, i + 1) if words[j][0] in X._OPEN or words[j].lstrip("([")[:1] in tuple(X._OPEN)]
    shut = lambda w: w.rstrip(".,;:!?)")[-1:]
    closed = [j for j in range(lo, i) if len(words[j]) > 1 and words[j][0] not in X._OPEN and shut(words[j]) and shut(words[j]) in X._CLOSE]
    return bool(opens) and not closed and any(shut(words[j]) and shut(words[j]) in X._CLOSE for j in range(i, hi))


def test_query_against_brute_force(spark):
    """The registered query's scores, from edit distances to the whole lexicon and windows looked at one by one."""
    import math

    import numpy as np

    from warcspark.llm.queries import QUERIES

    rng = random.Random(7)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randint(3, 5))) for _ in range(2))
        assert one_edit(a, b) == (distance(a, b) <= 1)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.fit_documents(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and (model.terms or model.stems)
    tiny = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.001").agg(F.max("predicted")).first()[0]
    assert tiny == 0  # too few labels for a lexicon: nothing is called toxic
    for r in rows:
        words = r.text.split() if r.text else []
        n = [0] * 5
        for i, k in enumerate(_hits(model, words)):
            if k:
                n[4 if _in_quotes(words, i) else k] += 1
        x = np.array([1.0, *(math.log1p(c) for c in n[1:])])
        want = 1 / (1 + math.exp(-max(-35, min(35, float(x @ X.ALIKE @ model.weights)))))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].hits == sum(n[1:]), (r.doc_id, n)
