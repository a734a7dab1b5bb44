import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.errors import CouldNotEmbed, DimensionMismatch
from corpusloom.operators import fusion, statistics, vectors
from corpusloom.operators.embedding import HashingProvider, Provider, embed_column, embed_pieces

VECTORS = [(1, 1, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 2, [0.0, 2.0]), (4, 2, [0.0, 0.0]), (5, 2, []), (6, 1, [2.0, 0.0])]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(VECTORS, "piece_id long, parent_id long, embedding array<float>")


def test_nearest(stored):
    got = [(r.piece_id, round(r.similarity, 6)) for r in vectors.topk(stored, [3.0, 0.0], 4).collect()]
    assert got == [(1, 1.0), (6, 1.0), (2, 0.6), (3, 0.0)]
    assert vectors.topk(stored, [1.0, 0.0], 0).count() == 0
    assert [r.piece_id for r in vectors.above(vectors.topk(stored, [1.0, 0.0], 4), 0.6).collect()] == [1, 6]
    assert [r.similarity for r in vectors.topk(stored, [0.0, 0.0], 2).collect()] == [0.0, 0.0]


def test_topk_is_one_stage(stored, capsys):
    vectors.topk(stored, [1.0, 0.0], 3).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_unit_vectors(stored):
    got = {r.piece_id: r.v for r in stored.select("piece_id", vectors.normalised(F.col("embedding")).alias("v")).collect()}
    assert got[3] == [0.0, 1.0] and got[4] == [0.0, 0.0] and got[5] == []


def test_dimensions_are_checked(spark, stored):
    assert vectors.check_dimension(stored, 2).count() == 5
    with pytest.raises(PySparkException):
        vectors.check_dimension(stored, 3).count()
    with pytest.raises(DimensionMismatch):
        vectors.check_query([1.0], 2)


def test_all_neighbours_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "piece_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {i: list(np.lexsort((np.arange(60), -(u[i] @ u.T)))[:4]) for i in range(60)}
    got: dict = {}
    for row in vectors.knn(df, df, 4, blocks=3).orderBy("query", "rank0").collect():
        got.setdefault(row["query"], []).append(row.neighbour)
    assert got == want


def test_mean_of_tokens(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [])], "doc long, embedding array<double>")
    assert {r.doc: r.embedding for r in vectors.mean_pool(df, "doc", 2).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def lists(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5)], "id long, score double")
    b = spark.createDataFrame([(3, 7.0), (4, 7.0)], "id long, score double")
    return [a, b, a.limit(0)]


def test_reciprocal_ranks(spark):
    got = {r.id: r.fused for r in fusion.fuse(lists(spark)).collect()}
    assert got == pytest.approx({1: 1 / 60, 2: 1 / 61, 3: 1 / 62 + 1 / 60, 4: 1 / 61})
    assert [r.id for r in fusion.with_rank(fusion.fuse(lists(spark))).orderBy("rank0").collect()] == [3, 1, 2, 4]


def test_relative_scores(spark):
    got = {r.id: r.fused for r in fusion.fuse(lists(spark), fusion.RELATIVE, [0.5, 0.5, 0.0]).collect()}
    assert got == pytest.approx({1: 0.5, 2: 0.0, 3: 0.5, 4: 0.5})
    assert fusion.fuse(lists(spark), fusion.RELATIVE, [1.0]).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(lists(spark), "other")


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0)], "k string, v double")
    got = {r.k: r for r in statistics.summary(df, "v", "k").collect()}
    assert got["a"].variance == pytest.approx(np.var([1, 2, 4], ddof=1)) and got["a"].relative == pytest.approx(np.std([1, 2, 4], ddof=1) / (7 / 3)) and got["b"].variance is None


def test_embedding(spark):
    p = HashingProvider(16)
    df = spark.createDataFrame([(1, 1, 0, "Some words here"), (2, 1, 0, "some WORDS here"), (3, 1, 1, "a caption"), (4, 1, 0, None), (5, 1, 0, "")], "id long, parent_id long, content_type int, text_content string")
    got = {r.piece_id: r.embedding for r in embed_pieces(df, p).collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[2] and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and set(got[5]) == {0.0}
    assert np.allclose(p.embed_query("words here some"), got[1], atol=1e-6)
    assert df.filter("id = 4").select(embed_column(F.col("text_content"), p)).first()[0] == []


class Broken(Provider):
    dimension = 3

    def embed(self, texts):
        return [None] * len(texts)


def test_a_model_without_vectors_fails(spark):
    with pytest.raises(PySparkException, match=CouldNotEmbed.__name__):
        spark.createDataFrame([("x",)], "t string").select(embed_column(F.col("t"), Broken())).collect()
