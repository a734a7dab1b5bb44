"""What a Python worker is given at once doesn't grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import bert
from corpusloom.functions.text import fold_query, slices
from corpusloom.operators.embedding import HashingProvider, Provider, embed_column
from corpusloom.operators import vectors
from corpusloom.plans import search


class Few(Provider):
    dimension = 2

    def embed(self, texts):
        assert len(texts) <= 256 and (len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 1 << 20)
        return [[float(len(t)), 1.0] for t in texts]


def test_a_model_is_given_slices(spark):
    text = F.when(F.col("id") % 7 == 0, F.repeat(F.lit("é"), 200_000)).when(F.col("id") % 7 < 6, F.concat(F.lit("text "), "id"))
    rows = spark.range(0, 700, 1, 1).select("id", text.alias("t"))
    got = rows.select("id", F.length("t").alias("n"), embed_column(F.col("t"), Few()).alias("v")).collect()
    assert len(got) == 700 and all(r.v == ([] if r.n is None else [float(r.n), 1.0]) for r in got)


def test_slices():
    texts = ["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 5]
    parts = [p.to_pylist() for p in slices(pa.array(texts), 3, 12)]
    assert sum(parts, []) == texts and parts == [["a" * 10, None], ["b" * 30], ["", "c" * 5, "d" * 5]]
    assert list(slices(pa.array([], pa.string()))) == []


def test_words_kept_are_bounded():
    p = HashingProvider(8)
    p.embed([" ".join(f"w{i}" for i in range(k, k + 1000)) for k in range(0, 150_000, 1000)])
    assert len(p.known) <= 100_000
    assert p.embed(["Éa ça_b 中 x"]) == p.embed(["ea ca b 中 x"]) and fold_query("ÉǅK") == "eǆk"


def test_candidates_need_no_python(spark):
    parts = [spark.createDataFrame([("semantic", 1, 2, 0.5)], search._CANDIDATES)]
    taken = search._taken(parts)
    assert "LocalTableScan" in taken._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in taken.collect()] == [("semantic", 1, 2, 0.5)] and search._taken([taken.limit(0)]).count() == 0


def test_no_more_words_are_sent_than_are_encoded(spark):
    v = bert.load_vocabulary(["[CLS]", "[SEP]", "[UNK]", "a", "##a", "b"])
    df = spark.createDataFrame([("a " * 5000,), ("a" * 100 + " " + "a" * 101 + " b",), ("b",), (None,)], "t string")
    out = df.select(bert.encode(F.col("t"), v, max_length=10).alias("e"))
    assert "slice(" in out._jdf.queryExecution().optimizedPlan().toString()
    got = [r.e.input_ids for r in out.collect()]
    assert got == [[0, *[3] * 8, 1], [0, 3, *[4] * 7, 1], [0, 5, 1], [0, 1]]
    assert df.select(bert.encode(F.col("t"), v, max_length=104)).collect()[1][0].input_ids == [0, 3, *[4] * 99, 2, 5, 1]


def test_a_search_cuts_texts_once(spark, monkeypatch):
    asked = []
    real = search.lexical.search
    monkeypatch.setattr(search.lexical, "search", lambda *a, **k: asked.append(k["held"]) or real(*a, **k))
    docs = spark.createDataFrame([(i, f"title {i}", "the and" if i == 3 else "none") for i in range(40)], "id long, title string, description string")
    pieces = docs.select("id", F.col("id").alias("parent_id"), F.when(F.col("id") < 5, "the cat and dog").otherwise("a bird").alias("text_content"))
    vectors = pieces.select(F.col("id").alias("piece_id"), "parent_id", embed_column(F.col("text_content"), HashingProvider(8)).alias("embedding"))
    found = search.search(docs, pieces, vectors, "the and", HashingProvider(8).embed_query("the and"), 3, 0.9, stemmed=False)
    assert len(asked) == 2 and asked[0] is asked[1] and len(asked[0]) == 2 and not any(h.is_cached for h in asked[0])
    assert [(r.document_id, r.title, r.piece_id, r.text_content) for r in found.collect()] == [(3, "title 3", 3, "the cat and dog"), (0, "title 0", 0, "the cat and dog"), (1, "title 1", 1, "the cat and dog")]
    assert "INSET" in found._jdf.queryExecution().optimizedPlan().toString() or " IN (" in found._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_normalised_in_place():
    m = np.random.default_rng(1).normal(size=(20_000, 64)).astype(np.float32)
    column = pa.chunked_array([pa.array(m.tolist(), pa.list_(pa.float32()))])
    tracemalloc.start()
    some, units = vectors._matrix(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = m.astype(float)
    assert len(some) == 20_000 and np.array_equal(units, d / np.sqrt((d * d).sum(axis=1, keepdims=True))) and peak < 1.5 * d.nbytes


def test_neighbours_of_more_queries_than_are_held_at_once(spark):
    x = np.random.default_rng(2).normal(size=(150, 5)).astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "piece_id long, embedding array<float>")
    got = vectors.knn(df, df, 3).orderBy("query", "rank0").collect()
    assert vectors.QUERY_ROWS < 150 and [r.neighbour for r in got] == [j for i in range(150) for j in np.lexsort((np.arange(150), -(u[i] @ u.T)))[:3]]
