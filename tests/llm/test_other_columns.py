"""Columns beside those that an operator works on: any name, any type, and they come through as they were."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from warcspark.llm import hnsw, language_id, mixing, near_dedup, toxicity

NAMES = ["score", "_text", "predicted", "hits", "Lang_Pred", "bits_per_byte", "_rows", "_hash", "_id", "_hash_of", "copies", "_n", "_h", "_s", "_i", "_k", "_run", "size", "left", "passes", "h", "with.dot", "back`tick", "__x", "address", "node", "component", "text_hash", "target", "shard"]


def wide(df):
    for c in NAMES:
        df = df.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    return df.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("nested", F.array(F.struct(F.col("m").alias("m"), F.lit(1.5).alias("x"))))


def plain(df):
    return sorted(map(str, (r.asDict(recursive=True) for r in df.collect())))


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["the cat sat on the mat and looked at the moon", "le chat est sur la table et regarde la lune", "you moron idiot scum " * 4, None, "", "the dog ran over the hill and far away today"]
    rows = [(i, texts[i % 6] and f"{texts[i % 6]} {i % 9}", ["en", "fr"][i % 6 == 1], f"s{i % 3}", 1) for i in range(60)] + [(7, "le chat est sur la table et regarde la lune 7", "fr", "s1", 1)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").cache()


def test_outputs_replace_their_names_or_get_a_prefix(docs):
    d = wide(docs)
    m = toxicity.Model([], [], frozenset(), __import__("numpy").zeros(5))
    got = toxicity.score(d, m, keep=tuple(d.columns))
    assert got.columns.count("score") == 1 and dict(got.dtypes)["score"] == "double" and got.count() == 63
    assert plain(toxicity.score(d, m, keep=tuple(d.columns), prefix="___").select(*[f"`{c.replace('`', '``')}`" for c in d.columns])) == plain(d)
    model = language_id.fit_documents(d)
    got = language_id.identify(d, model, keep=tuple(d.columns))
    assert [c for c in got.columns if c.lower() == "lang_pred"] == ["lang_pred"] and got.where("lang_pred is null").count() == 0
    want = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert {r.doc_id: r.lang_pred for r in got.select("doc_id", "lang_pred").collect()} == want


@pytest.mark.parametrize("name", ["language_id", "toxicity", "near_dedup", "mixing"])
def test_stages_give_other_columns_back(spark, docs, name, tmp_path):
    """The same rows with and without them, and each row with its own."""
    stage = dict(C.STAGES)[name]
    docs.select("doc_id", F.lit(0).alias("toxic")).distinct().write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, wide(docs), str(tmp_path))
    assert got.columns == wide(docs).columns
    assert plain(got) == plain(wide(stage(spark, docs, str(tmp_path))))


def test_one_of_each_and_repeated_with_maps(spark, docs):
    d = wide(docs)
    kept = near_dedup.one_of_each(d)
    assert plain(kept.select("doc_id", "text")) == plain(near_dedup.one_of_each(docs).select("doc_id", "text"))
    more = mixing.repeated(d)
    assert more.count() == mixing.repeated(docs).count() and set(plain(more)) <= set(plain(d))


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e39, 1e200])
def test_queries_of_any_length_find_their_nearest(scale):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(1500, 16))
    g = hnsw.Graph(x * 1e-3)
    got = g.search_all(x[:100] * scale, 10)
    best = np.argsort(-(x[:100] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, best, strict=True)]) >= 0.9
