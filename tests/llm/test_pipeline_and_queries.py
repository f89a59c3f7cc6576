import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_mixing import targets
from tests.llm.test_near_dedup import brute
from warcspark.llm import language_id, mixing, packing, toxicity
from warcspark.llm.queries import ORACLE_SQL, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_their_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op1_toxicity", "op5_language_id"}))  # those have brute force over all rows
def test_queries_cover_their_whole_table(spark, name):
    got = QUERIES[name](spark, SF)
    table = {"op2": "embeddings", "op4": "embeddings", "op7": "pages", "op10": "pages", "op11": "pages"}.get(name.split("_")[0], "documents")
    key = {"embeddings": "vec_id", "pages": "page_id", "documents": "doc_id"}[table]
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    rows = got.collect()
    if table == "embeddings":
        every = {"op2": 20, "op4": 50}[name.split("_")[0]]
        assert {r.query_id for r in rows} == {i for i in ids if i % every == 0}
    elif name != "op8_licenses":
        assert {r[key] for r in rows} == ids


def _language(docs, spark):
    """Ids that stay: in the code of some language, text by text, a letter and at most MAX_BITS bits a byte."""
    m = language_id.fit_documents(docs)
    out = []
    for r in docs.collect():
        if r.text and any(c.isalpha() for c in r.text):
            cost, n = m.code_lengths([language_id.text_bytes(r.text)])
            out += [r.doc_id] if cost[0].min() / n[0] <= C.MAX_BITS else []
    return out


def _toxicity(docs, spark):
    m = toxicity.fit_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    return [r.doc_id for r in docs.collect() if m.scores(np.array([m.features(r.text)]))[0] < 0.5]


def _near_dedup(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    return [i for i, (_, c) in brute(rows).items() if i == c]


def _check_mix(before, rows):
    """Copies of rows only, three of each at most, and each source's words near its target."""
    size, want, took = {}, {}, {}
    of = {r.doc_id: r for r in before}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(WORDS.findall(r.text or ""))
    for r in rows:
        assert tuple(r) == tuple(of[r.doc_id])
        took[r.source] = took.get(r.source, 0) + len(WORDS.findall(r.text or ""))
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    want = targets(size)
    longest = {s: max(len(WORDS.findall(r.text or "")) for r in before if r.source == s) for s in size}
    # a shard may round its last document up or down
    assert all(abs(took.get(s, 0) - want[s]) <= max(0.05 * float(want[s]), 4 * longest[s]) for s in size), (took, want)


def test_stages_step_by_step(spark):
    """Each stage on all that the one before kept, held against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*C.COLUMNS)
    assert [n for n, _ in C.STAGES] == ["language_id", "toxicity", "near_dedup", "mixing", "packing"]
    plain = {"language_id": _language, "toxicity": _toxicity, "near_dedup": _near_dedup}
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        kept[name] = rows
        before, docs = docs, spark.createDataFrame(rows, out.schema)
        if name in plain:
            assert sorted(r.doc_id for r in rows) == sorted(plain[name](before, spark)) and rows
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before.collect()}
        elif name == "mixing":
            _check_mix(before.collect(), rows)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), []
    for r in before.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    strip = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(kept["packing"]) == sorted(want)
    ends = {}
    for r in sorted(kept["packing"], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert strip(C.run(spark, SF).collect()) == sorted(want)


def test_stages_lose_and_invent_no_rows(spark):
    """Unlike texts of one id stay, copies go, and null ids take part in the mix as often as they stand."""
    stages = dict(C.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = "the first text of an id with words of its own", "another one that shares nothing with it at all"
    docs = spark.createDataFrame([(1, one, "en", "a", 1), (1, two, "en", "a", 1), (2, one, "en", "a", 1), (1, two, "en", "a", 1)], schema)
    got = stages["near_dedup"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(1, one), (1, two)])
    rows = [(None, f"n{i} a b c", "en", "a" if i % 2 else None, i) for i in range(300)] + [(i, f"m{i} d e f", "en", "b", i) for i in range(100)]
    mixed = stages["mixing"](spark, spark.createDataFrame(rows, schema), SF).collect()
    taken = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(mixed) == sum(int(r.taken / r.size + 0.5) for r in taken)
    assert abs(len(mixed) - sum(r.taken for r in taken) / 4) <= 3 and set(map(tuple, mixed)) <= set(rows)
    assert max(Counter(map(tuple, mixed)).values()) <= 3


def test_stages_with_odd_rows(spark):
    rows = [(None, "a b c d e f", "en", None, None), (1, None, None, "s", 1), (2, "", "en", "s", 0), (3, "the cat sat on the mat", "en", "s", 5), (3, "the cat sat on the mat", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        again = stage(spark, docs.limit(0), SF)
        assert again.count() == 0
        if name != "packing":
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert out.count() >= 1
