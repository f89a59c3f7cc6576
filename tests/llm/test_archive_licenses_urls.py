import base64
import gzip
import hashlib
import io
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from warcspark.llm import licenses, url_filter, warc_archive
from warcspark.llm.common import staging_path
from warcspark.options import WarcOptions
from warcspark.sources.framing import frames

PAGES = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (9, "http://a/9", "x"), (3, None, None), (4, "http://a/4", ""), (5, "u\r\nX: y", "é漢"), (5, "u\r\nX: y", "é漢"), (None, "n", "q"), (6, "b", "z" * 300000), (7, "c", "z" * 300000), (None, "m", "x")]


def _b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_archive_round_trip(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("header", F.lit("clash"))
    got = warc_archive.archive_round_trip(df, min_bytes=least).collect()
    want = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        ids = [j for j, _, g in PAGES if (g or "").encode() == p and j is not None]
        top = max(ids, default=None)
        revisit = len(p) >= least and top is not None and i != top
        want.append((i, len(p), _b32(p), "revisit" if revisit else "response", top if revisit else None, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc_archive.archive_round_trip(df.limit(0)).count() == 0


def test_archive_records_are_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = staging_path(spark, "t")
    warc_archive.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "").encode() for *_, h in PAGES})
    rows = warc_archive.read_archive(spark, path).collect()
    data = b"".join(gzip.compress(bytes(r.record)) for r in rows)
    back = list(frames(io.BytesIO(data), WarcOptions.strict()))
    assert len(back) == len(PAGES) and not any(r["error"] for r in back)
    for r, b in zip(rows, back, strict=True):
        head, _, body = b["block"].partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK") and body == (b"" if r.record_type == "revisit" else bytes(r.payload))


def test_broken_payloads_are_told(spark):
    path = staging_path(spark, "t")
    warc_archive.write_archive(spark.createDataFrame([(1, "u", "good"), (2, "u", "bad")], "page_id long, url string, html string"), path)
    p = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.when(F.col("payload") == F.lit(b"bad"), F.lit(b"bat")).otherwise(F.col("payload")))
    p.write.parquet(f"{path}/x/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/x/headers")
    got = {r.record_id: r.verified for r in warc_archive.read_archive(spark, f"{path}/x").collect()}
    assert got == {"<urn:page:1>": True, "<urn:page:2>": False}


def _coverage(index, k, words):
    """Best number of matched words over all places, by plain local alignment."""
    t = index.words[k]
    best, rows = (0, 0), [(0, 0)] * (len(words) + 1)
    for w in t:
        new = [(0, 0)]
        for j, x in enumerate(words):
            d = rows[j]
            ways = [(d[0] + (1 if x == w else -1), d[1] + (x == w)), (rows[j + 1][0] - 1, rows[j + 1][1]), (new[j][0] - 1, new[j][1])]
            m = max(ways)
            new.append(m if m[0] > 0 else (0, 0))
            best = max(best, new[-1])
        rows = new
    return best[1] / len(t)


def test_licenses_against_full_alignment():
    index, rng = licenses.Index(licenses.TEMPLATES), random.Random(4)
    short = [n for n in index.names if len(licenses.TEMPLATES[n].split()) < 80]
    noise = [f"n{i}" for i in range(50)]
    found = 0
    for i in range(110):
        name = rng.choice(short) if i % 5 else rng.choice(index.names)
        words = licenses.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(noise)] * rng.randint(0, 1)
        text = " ".join([*rng.choices(noise, k=20), *words, *rng.choices(noise, k=20)])
        got = {m[0]: m for m in index.matches(text, every=True)}
        plain = [licenses.plain(w) for w in text.split()]
        for k, n in enumerate(index.names):
            c = _coverage(index, k, plain)
            if n in got:
                assert got[n][1] == pytest.approx(c)
                assert text[got[n][4] : got[n][5]].split() == text.split()[got[n][2] : got[n][3] + 1]
            elif len(index.words[k]) > 15:
                assert c < licenses.COVERAGE
        found += name in got
    assert found > 90


def test_licenses_miss_no_template():
    index, rng = licenses.Index({n: t for n, t in licenses.TEMPLATES.items() if len(t.split()) < 40}), random.Random(5)
    for text, name, coverage in [
        ("Licensed under the MIT License", "mit", 4 / 5),
        ("Distributed under the MIT License", "mit", 4 / 5),
        ("Released under the MIT", "mit", 4 / 5),
        ("Released under this MIT License", "mit", 4 / 5),
        ("Licensed under Apache License, Version 2.0", "apache-2.0", 6 / 7),
        ("Licensed under the X11 Apache License, Version 2.0", "apache-2.0", 1.0),
        ("Released under the MIT Released under the MIT License", "mit", 4 / 5),
    ]:
        assert (name, pytest.approx(coverage)) in [m[:2] for m in index.matches(text, every=True)], text
    noise = [f"n{i}" for i in range(50)]
    found = 0
    for _ in range(800):
        words = licenses.TEMPLATES[rng.choice(index.names)].split()
        for _ in range(rng.randint(0, 1 + len(words) // 3)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 1)] = rng.choices(noise, k=rng.randint(0, 1))
        text = " ".join([*rng.choices(noise, k=10), *words, *rng.choices(noise, k=10)])
        got = defaultdict(float)
        for n, c, *_ in index.matches(text, every=True):
            got[n] = max(got[n], c)
        plain = [licenses.plain(w) for w in text.split()]
        for k, n in enumerate(index.names):
            c = _coverage(index, k, plain)
            assert got[n] == pytest.approx(c) if c >= licenses.COVERAGE else not got[n], (n, text)
            found += c >= licenses.COVERAGE
    assert found > 300


def test_long_licenses_within_the_stated_edits():
    index, rng = licenses.Index(licenses.TEMPLATES), random.Random(11)
    long = [k for k, t in enumerate(index.words) if len(t) > licenses.SHORT]
    assert len(long) >= 9 and all(index.run(k, licenses.COVERAGE) == (3, 2, 2) for k in long)
    for h in (index.ids[k] for k in long):
        hashes, at = licenses.winnow(h, 2, 2)
        assert len(hashes) < len(h) - 1 and all(b - a <= 2 for a, b in zip(at, at[1:], strict=False)) and at[0] <= 1
    noise, found = [f"n{i}" for i in range(50)], 0
    for _ in range(60):
        k = rng.choice(long)
        words = index.words[k].copy()
        for _ in range(rng.randint(0, len(words) // 4)):
            at, how = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (how < 2)] = [rng.choice(noise)] * (how > 0)
        text = " ".join([*rng.choices(noise, k=10), *words, *rng.choices(noise, k=10)])
        got = max((c for n, c, *_ in index.matches(text, every=True) if n == index.names[k]), default=0.0)
        c = _coverage(index, k, text.split())
        assert got == pytest.approx(c) if c >= licenses.COVERAGE else not got, (index.names[k], text)
        found += c >= licenses.COVERAGE
    assert found > 30


def test_near_licenses_are_told_apart():
    index, rng, t = licenses.Index(licenses.TEMPLATES), random.Random(8), licenses.TEMPLATES
    assert len({n.split("-")[0] for n in t}) >= 9 and sum(len(x.split()) > 60 for x in t.values()) >= 9
    for name in t:
        if len(t[name].split()) > 25 and name not in ("bsd", "mit-grant", "gpl-notice"):
            for edits in (0, 1, 5):
                words = t[name].split()
                for _ in range(edits):
                    words[rng.randrange(len(words))] = "edited"
                text = "Copyright (c) someone. " + " ".join(words) + " and so on"
                got = [m for m in index.matches(text) if m[0].split("-")[0] == name.split("-")[0]]
                # a few edits may fall on the very words that tell two licenses apart
                assert got[0][0] == name or (edits and index.ids[index.names.index(got[0][0])] != index.ids[index.names.index(name)]), (name, got)
                if not edits:
                    assert [m[:2] for m in got] == [(name, 1.0)], (name, got)
    two = "Copyright X. " + t["bsd-2-clause"] + " Then. " + t["bsd-3-clause"]
    assert [m[0] for m in index.matches(two)] == ["bsd-2-clause", "bsd-3-clause"]


def test_licenses_defined_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (4, "w " * 50000 + mit + " w " * 50000 + mit), (None, mit.upper()), (5, "under the MIT")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit("clash"))
    got = licenses.scan(df).collect()
    assert sorted((str(r.doc_id), r.license, r.coverage) for r in got) == [("3", "mit", 1.0), ("3", "mit", 1.0), ("4", "mit", 1.0), ("4", "mit", 1.0), ("None", "mit", 1.0)]
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, {"none": "..."}).count() == 0


def _judge(rules, default, url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else default


def test_urls_against_every_rule(spark):
    from warcspark.llm.queries import URL_RULES

    rng = random.Random(6)
    rules = [*URL_RULES, url_filter.Rule("block", "b.example.org", ""), url_filter.Rule("allow", "x-y.com", "/a.b(c/"), url_filter.Rule("block", "net", "/q")]
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "notexample.org", "com", "x-y.com", "z.net", "net", "", "org.", "ö.org", "a\nb.org"]
    paths = ["", "/", "/es/", "/en/1", "/en/12?x=/es/", "/en/2", "/fr/#a", "/de/x", "/a.b(c/", "/Es/", "/q\n/de/", "?/fr/", "#/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "example.org/es/", "a://b://c", "http:/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("other", F.lit(1))
    got = url_filter.filter_urls(df, rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: _judge(rules, "allow", u) for i, u in enumerate(urls)}
    assert got[0].other == 1
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, [], default="block").collect()} == {"block"}


def test_only_candidates_run():
    rules = [url_filter.Rule("block", f"h{i}.com", f"/p{i}/") for i in range(1000)]
    index = url_filter.RuleIndex(rules, {"h:com": 10**6})
    assert not index.always and max(map(len, index.by_token.values())) == 1
    assert index.judge("a.h7.com", "/p7/x") == ("h7.com/p7/", "block") and index.judge("h7.com", "/p8/") is None
