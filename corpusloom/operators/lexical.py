"""Full-text search by BM25, by a scan or over stored postings.

rank = -sum over query tokens of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * |D| / avg|D|)), idf = ln((N - n + 0.5) / (n + 0.5)) or 1e-6 where
that is not positive; all statistics are of the whole corpus, whatever the hits are restricted to.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.porter import stem, stems
from corpusloom.functions.text import normalise_query, query_words, words

ANY, ALL = "any", "all"
K1, B = 1.2, 0.75


def indexed(rows: DataFrame, columns: list[str], index_ids: list[str] = ()) -> Column:
    """The tokens of a row over all indexed columns; ids only where asked for."""
    return F.concat(*[words(F.col(c).cast("string")) for c in [*index_ids, *columns]])


def idf(n_rows: Column, n_with: Column) -> Column:
    raw = F.log((n_rows - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, 1e-6).otherwise(raw)


def _forms(tokens: DataFrame, query: list[str]) -> dict[str, list[str]]:
    """For each stem of the query the words of the corpus that have it; only words that begin like it are stemmed."""
    wanted = list(dict.fromkeys(stem(q) for q in query))
    begins = reduce(lambda a, b: a | b, [F.col("w").startswith(s[: max(1, len(s) - 2)]) for s in wanted])
    found = tokens.select(F.explode("tokens").alias("w")).filter(begins).distinct().withColumn("s", stems("w"))
    out: dict[str, list[str]] = {s: [] for s in wanted}
    for r in found.filter(F.col("s").isin(wanted)).collect():  # the inflections of the query's words
        out[r.s].append(r.w)
    return out


def _count(tokens: str, forms: list[str]) -> Column:
    """How many of the tokens are one of the forms."""
    return F.size(F.filter(tokens, lambda t: t.isin(forms) if forms else F.lit(False))).cast("double")


def search(rows: DataFrame, query: str, columns: list[str], match: str = ALL, limit: int | None = None, key: str = "id", stemmed: bool = True, index_ids: list[str] = (), restrict: Column | None = None, keep: list[str] | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """The columns of rows, or those of them to keep, with ``rank`` (lower is better), best first, ties by key.

    One scan takes N, the mean length and each token's rows; a second scores. Neither shuffles tokens. A query without tokens has no hits.
    With ``held``, texts are cut into words once: what is kept of each row and its counts are persisted, and added to that list for the caller to unpersist.
    """
    keep = rows.columns if keep is None else keep
    asked = query_words(normalise_query(query))
    if not asked:
        return rows.select(*keep, F.lit(0.0).alias("rank")).limit(0)
    tokens = rows.withColumn("tokens", indexed(rows, columns, list(index_ids)))
    forms = _forms(tokens, asked) if stemmed else {q: [q] for q in asked}
    frequency = [_count("tokens", ws) for ws in forms.values()]
    # a generated column: the filter on hits stays above it, where below it would split each text once more for every word asked
    once = F.explode(F.array(F.struct(F.size("tokens").cast("double").alias("len"), F.array(*frequency).alias("f")))).alias("_c")
    counted = tokens.select(*keep, once).select(*keep, F.col("_c.len").alias("_len"), F.col("_c.f").alias("_f"))
    if held is not None:
        held.append(counted.persist(StorageLevel.MEMORY_AND_DISK))
    m = len(frequency)
    stats = counted.agg(F.count("*").cast("double").alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.sum((F.col("_f")[i] > 0).cast("double")) for i in range(m)]).alias("_df"))
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    f = [F.col("_f")[i] for i in range(m)]
    part = [idf(F.col("_n"), F.col("_df")[i]) * f[i] * (K1 + 1) / (f[i] + K1 * (1 - B + B * F.col("_len") / F.col("_avg"))) for i in range(m)]
    hit = reduce((lambda a, b: a & b) if match == ALL else (lambda a, b: a | b), [x > 0 for x in f])
    out = joined.filter(hit if restrict is None else hit & restrict).select(*keep, (-reduce(lambda a, b: a + b, part)).alias("rank"))
    out = out.orderBy("rank", key)
    return out if limit is None else out.limit(limit)


#: The token under which an index has the length of every row.
LENGTH = ""


def index(rows: DataFrame, columns: list[str], keys: list[str], stemmed: bool = True) -> DataFrame:
    """(token, keys, f, len): the inverted index to be stored, with the length of every row under ``LENGTH``; distinct words are stemmed, not running text."""
    tokens = rows.select(*keys, indexed(rows, columns).alias("tokens")).withColumn("len", F.size("tokens"))
    counts = tokens.select(*keys, "len", F.explode("tokens").alias("token")).groupBy(*keys, "len", "token").agg(F.count("*").alias("f"))
    if stemmed:
        vocabulary = counts.select("token").distinct().withColumn("stem", stems("token"))
        counts = counts.join(vocabulary, "token").groupBy(*keys, "len", F.col("stem").alias("token")).agg(F.sum("f").alias("f"))
    lengths = tokens.select(F.lit(LENGTH).alias("token"), *keys, F.lit(0).cast("long").alias("f"), "len")
    return counts.select("token", *keys, F.col("f").cast("long").alias("f"), "len").unionByName(lengths)


def search_index(index: DataFrame, query: str, keys: list[str], match: str = ALL, limit: int | None = None, stemmed: bool = True, restrict: Column | None = None) -> DataFrame:
    """(keys, rank) from a stored index, best first, ties by the first key: only the rows of the query's tokens and the lengths are read."""
    asked = query_words(normalise_query(query))
    asked = list(dict.fromkeys(stem(q) for q in asked)) if stemmed else asked
    mine = index.filter(F.col("token").isin(asked) if asked else F.lit(False))
    stats = index.filter(F.col("token") == LENGTH).agg(F.count("*").cast("double").alias("_n"), F.avg("len").alias("_avg"))
    df = mine.groupBy("token").agg(F.count("*").cast("double").alias("_df"))  # a row for each word asked
    f = F.col("f").cast("double")
    part = idf(F.col("_n"), F.col("_df")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("_avg")))
    hits = mine if restrict is None else mine.filter(restrict)
    scored = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats)).groupBy(*keys).agg((-F.sum(part)).alias("rank"), F.count("*").alias("_t"))
    out = scored.filter(F.col("_t") == len(asked)) if match == ALL else scored
    out = out.select(*keys, "rank").orderBy("rank", keys[0])
    return out if limit is None else out.limit(limit)


def corpus_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, avg_len, n_tokens, n_distinct over the indexed columns."""
    tokens = rows.select(indexed(rows, columns).alias("tokens"))
    sizes = tokens.agg(F.count("*").alias("n_rows"), F.avg(F.size("tokens")).alias("avg_len"), F.sum(F.size("tokens")).alias("n_tokens"))
    kinds = tokens.select(F.explode("tokens").alias("w")).agg(F.count_distinct("w").alias("n_distinct"))
    return sizes.crossJoin(kinds)


def document_frequency(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(token, n_rows) of every token."""
    return rows.select(F.explode(F.array_distinct(indexed(rows, columns))).alias("token")).groupBy("token").agg(F.count("*").alias("n_rows"))
