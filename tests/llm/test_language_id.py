import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from warcspark.llm import language_id as L

ENGLISH = ["the cat sat on the mat and the dog ran to the house", "this is the story of the king and the queen of the land", "where are you going with that old hat"]
GERMAN = ["der hund und die katze laufen in das haus", "das ist die geschichte von dem könig und der königin", "wohin gehst du mit dem alten hut"]


def bits(texts, order, text):
    """Code length by the definition, byte by byte."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]

    def prepared(t):
        b = L.text_bytes(t)
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        return b"\0" * order + b

    for t in texts:
        b = prepared(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[i - k : i]][b[i]] += 1
    total, b = 0.0, prepared(text)
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts[k].get(b[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    m = L.fit({"de": GERMAN, "en": ENGLISH})
    for text in [*ENGLISH, *GERMAN, "a", "zzz qq", "ŷ漢字 z  z!!", "Der KÖNIG, the king."]:
        got, n = m.code_lengths([L.text_bytes(text)])
        assert [round(x, 3) for x in got[0]] == [round(bits(t, L.ORDER, text), 3) for t in (GERMAN, ENGLISH)]


def test_batches_agree_with_single_texts():
    m = L.fit({"de": GERMAN, "en": ENGLISH})
    texts = [L.text_bytes(t) for t in [*ENGLISH, "", *GERMAN]]
    together, _ = m.code_lengths(texts)
    for t, row in zip(texts, together, strict=True):
        if t:
            assert abs(m.code_lengths([t])[0][0] - row).max() < 1e-3


def test_defined_cases(spark):
    m = L.fit({"de": GERMAN, "en": ENGLISH})
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, ENGLISH[0]), (4, ENGLISH[0]), (5, GERMAN[1] * 3000), (None, GERMAN[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(7))
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(df.select("doc_id", "text"), m).collect()]
    assert sorted((str(i), p) for i, p, _ in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("4", "en"), ("5", "de"), ("None", "de")]
    assert all(s == 0 for _, p, s in got if p == "und") and all(0.5 <= s <= 1 for _, p, s in got if p != "und")
    assert L.identify(df.select("doc_id", "text").limit(0), m).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(i, "some text", None) for i in range(8)], "doc_id long, text string, lang string")
    m = L.fit_documents(df)
    assert m.languages == [] and {r.lang_pred for r in L.identify(df, m).collect()} == {"und"}


def test_sample_is_bounded_and_training_rows_only(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.sample(df, ~L.held_out(F.col("doc_id")), rows=50)
    assert {k: len(v) for k, v in got.items()} == {"de": 50, "en": 50}
    held = {r.text for r in df.where(L.held_out(F.col("doc_id"))).collect()}
    assert not held & {t for v in got.values() for t in v}


def test_long_texts_go_in_pieces(monkeypatch):
    m = L.fit({"de": GERMAN, "en": ENGLISH})
    texts = [L.text_bytes(t) for t in (" ".join(GERMAN * 40), "a", "x  " * 300 + "  the king", " " * 500, "ü" * 333)]
    whole = [m.code_lengths([t]) for t in texts]
    for size in (1, 2, 7, 64, 333):
        monkeypatch.setattr(L, "CHUNK", size)
        got, n = m.code_lengths(texts)
        for (bits_, length), g, k in zip(whole, got, n, strict=True):
            assert abs(bits_[0] - g).max() < 1e-2 and length[0] == k


def test_a_long_text_takes_memory_by_its_length():
    """In a process of its own: 20 MB in four languages within 300 MB more than at the start."""
    import subprocess
    import sys

    code = """
import resource
from warcspark.llm import language_id as L
text = "der hund und die katze the cat sat on the mat " * 440000
m = L.fit({k: ["der hund und die katze", "the cat sat on", "le chat et le chien"] for k in "abcd"})
m.code_lengths([L.text_bytes("warm up " * 99)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m.code_lengths([L.text_bytes(text)])
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n > 20_000_000 and mb < 300


def test_sample_is_bounded_by_rows_and_letters(spark):
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    one = spark.createDataFrame([(8, "x" * 5000, "de"), (9, "short", "de")], "doc_id long, text string, lang string")
    got = L.sample(rows.unionByName(one), F.lit(True), rows=50, chars=2000)
    assert len(got["en"]) == 50 and got["de"] == ["short"]
    few = L.sample(rows, F.lit(True), rows=50, chars=100)
    assert 5 <= len(few["en"]) < 15 and sum(map(len, few["en"])) <= 100


def test_query_against_the_definition(spark):
    """The registered query's result, from counts of contexts byte by byte."""
    from warcspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    fitted = L.sample(docs, ~L.held_out(F.col("doc_id")))
    rows = sorted(docs.select("doc_id", "text", "lang", L.held_out(F.col("doc_id")).alias("h")).collect(), key=lambda r: len(r.text or ""))
    assert len(got) == len(rows) and {i for i, r in got.items() if r.held_out} == {r.doc_id for r in rows if r.h}
    short = {k: v[:6] for k, v in fitted.items()}
    m = L.fit(short)
    some = [r for r in rows if r.text and L.has_letter(r.text)][:12]
    for r, g in zip(some, m.code_lengths([L.text_bytes(r.text) for r in some])[0], strict=True):
        assert [round(x, 1) for x in g] == [round(bits(short[k], L.ORDER, r.text), 1) for k in sorted(short)]
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if r.h and r.lang and L.has_letter(r.text)]
    assert sum(right) >= 0.9 * len(right)
    assert all((got[r.doc_id].lang_pred == "und") == (not L.has_letter(r.text)) for r in rows)
