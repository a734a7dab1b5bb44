"""Exact nearest neighbours by cosine.

Stored vectors are floats, which carry about seven digits: similarities are rounded to as many, so that ties are ties whatever the order of a sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import DimensionMismatch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Of unit length, in doubles; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def unit(vector) -> list[float]:
    """The same for the vector of a query."""
    v = np.asarray(vector, float)
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n > 0 else v).tolist()


def literal(vector) -> Column:
    return F.lit([float(x) for x in vector])


def similarities(vectors: DataFrame, query, vector: str = "embedding") -> DataFrame:
    """The column ``similarity`` to one query; the query is a literal, so the scan stays whole-stage and nothing is joined."""
    q = literal(unit(query))
    n = norm(F.col(vector))
    inner = dot(F.col(vector), q)
    return vectors.withColumn("similarity", F.when(n > 0, inner / n).otherwise(0.0))


def topk(vectors: DataFrame, query, k: int, key: str = "piece_id", vector: str = "embedding", stored_unit: bool = False) -> DataFrame:
    """The k most similar, ties by key; rank0 counts from 0. With ``stored_unit`` vectors are known to be of unit length."""
    scored = vectors.filter(F.size(vector) > 0)
    if stored_unit:
        scored = scored.withColumn("similarity", dot(F.col(vector), literal(unit(query))))
    else:
        scored = similarities(scored, query, vector)
    scored = scored.withColumn("similarity", F.round("similarity", 7))
    return scored.drop(vector).orderBy(F.desc("similarity"), key).limit(max(0, k))


def above(hits: DataFrame, cutoff: float) -> DataFrame:
    """Strictly more similar than the cutoff; to be applied after the limit."""
    return hits.filter(F.col("similarity") > cutoff)


def check_dimension(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Vectors to be stored: empty ones are left out, others of another dimension fail."""
    right = F.when(F.size(vector) == dimension, True).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {dimension}")))
    return vectors.filter(F.size(vector) > 0).filter(right.cast("boolean"))


def check_query(query, dimension: int) -> None:
    if len(query) != dimension:
        raise DimensionMismatch(f"the query has dimension {len(query)}, not {dimension}")


BLOCK_ROWS = 20_000
#: Queries whose similarities to a block are held at once, twice: 10 MB with the largest block.
QUERY_ROWS = 64


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows that have a vector, their unit vectors)."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(size)
    if not len(some):
        return some, np.empty((0, 0))
    m = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
    for at in range(0, len(m), 1024):
        part = m[at : at + 1024]
        n = np.sqrt((part * part).sum(axis=1, keepdims=True))
        np.divide(part, n, out=part, where=n > 0)
    return some, m


def knn(queries: DataFrame, vectors: DataFrame, k: int, blocks: int | None = None, key: str = "piece_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of every query, exactly: query, neighbour, similarity, rank0. All vectors have one dimension.

    Queries and vectors are cut into blocks; each pair of blocks is one matrix product in a task, which passes on only k rows a query. What
    a task holds is two blocks, so unless it is given, their number follows from how many rows there are; the shuffle carries each row that many times.
    """
    if blocks is None:
        blocks = max(1, -(-max(queries.count(), vectors.count()) // BLOCK_ROWS))
    q = queries.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("qb"), F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(True).alias("is_query"))
    v = vectors.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("vb"), F.col(key).alias("id"), F.col(vector).alias("v"), F.lit(False).alias("is_query"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    both = q.withColumn("vb", F.explode(every)).unionByName(v.withColumn("qb", F.explode(every)))

    def product(t: pa.Table) -> pa.Table:
        out_q, out_n, out_s = [], [], []
        ask = t.column("is_query").to_numpy()
        ids = t.column("id").to_numpy()
        rows, units = _matrix(t.column("v"))
        a, b = np.flatnonzero(ask[rows]), np.flatnonzero(~ask[rows])
        if len(a) and len(b):
            a_ids, b_ids, y = ids[rows[a]], ids[rows[b]], units[b].T
            for at in range(0, len(a), QUERY_ROWS):
                s = units[a[at : at + QUERY_ROWS]] @ y
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                for i, row in enumerate(s):
                    some = np.flatnonzero(row >= least[i])
                    best = some[np.lexsort((b_ids[some], -row[some]))][:k]
                    out_q.append(np.full(len(best), a_ids[at + i]))
                    out_n.append(b_ids[best])
                    out_s.append(row[best])
        one = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query": pa.array(one(out_q, np.int64), pa.int64()), "neighbour": pa.array(one(out_n, np.int64), pa.int64()), "similarity": pa.array(one(out_s, float), pa.float64())})

    from pyspark.sql import Window

    part = both.groupBy("qb", "vb").applyInArrow(product, "query long, neighbour long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return part.withColumn("rank0", F.row_number().over(order) - 1).filter(F.col("rank0") < k)


def mean_pool(vectors: DataFrame, by: str, dimension: int, vector: str = "embedding") -> DataFrame:
    """The mean vector of each group, in doubles; a group without vectors has the zero vector."""
    sums = [F.avg(F.when(F.size(vector) == dimension, F.col(vector)[i].cast("double"))) for i in range(dimension)]
    return vectors.groupBy(by).agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias(vector))
