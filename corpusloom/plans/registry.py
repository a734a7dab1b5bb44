"""The queries of the retrieval engine over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import bert
from corpusloom.functions.porter import stem
from corpusloom.functions.text import BARE, MARKED, WORD, basic_tokens, clean_text, normalise_query, pad_ideographs
from corpusloom.operators import chunking, fusion, lexical, paged, statistics, vectors
from corpusloom.operators.embedding import HashingProvider, embed_column
from corpusloom.plans import reads
from corpusloom.plans import search as hybrid
from corpusloom.plans import workspace
from corpusloom.plans.store import Store
from corpusloom.schema import ANCHOR, describe_anchor
from corpusloom.sources.reader import digest_html_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


# the relations of the engine over the test tables


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, uuid, title, description, text of the documents table."""
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5(F.col("doc_id").cast("string")).alias("uuid"), F.concat_ws("-", "source", "doc_id").alias("title"), F.element_at(F.split("text", "\n"), 1).alias("description"), "text")


def conversation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as documents, titled and described by their first turn, and turns as pieces."""
    c = _table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("description"))
    documents = first.select(F.col("conv_id").cast("long").alias("id"), F.md5(F.col("conv_id").cast("string")).alias("uuid"), F.concat(F.lit("conversation "), "conv_id").alias("title"), "description")
    pieces = c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.col("conv_id").cast("long").alias("parent_id"), F.lit(0).alias("content_type"), F.col("text").alias("text_content"), F.col("turn").cast("int").alias("sequence_index"))
    return documents, pieces


def _pieces_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("piece_id"), F.col("label").cast("long").alias("parent_id"), "embedding")


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The query's vector: one row by key."""
    return list(_table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


CONVERSATION_DOCS = "SELECT conv_id AS id, md5(CAST(conv_id AS VARCHAR)) AS uuid, 'conversation ' || conv_id AS title, arg_min(text, turn) AS description FROM conversations GROUP BY conv_id"
CONVERSATION_PIECES = "SELECT conv_id * 1000 + turn AS id, conv_id AS parent_id, text AS text_content, turn AS sequence_index FROM conversations"

# vectors


def _sim(vec_id: int) -> str:
    return f"""sim{vec_id} AS (
      SELECT e.vec_id AS piece_id, e.label AS parent_id,
        round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 7) AS similarity
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q)"""


def _top(vec_id: int, k: int, where: str = "true") -> str:
    return f"{_sim(vec_id)}, top{vec_id} AS (SELECT * FROM sim{vec_id} WHERE {where} ORDER BY similarity DESC, piece_id LIMIT {k})"


_SHOWN = "piece_id, CAST(parent_id AS BIGINT) AS parent_id, similarity"


@_query("vector_topk", f"WITH {_top(0, 10)} SELECT {_SHOWN} FROM top0")
def vector_topk(spark, sf_dir):
    hits = vectors.topk(_pieces_of_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 10)
    return hits.select("piece_id", "parent_id", "similarity")


@_query("vector_topk_in_collection", f"WITH {_top(1, 10, 'parent_id = 3')} SELECT {_SHOWN} FROM top1")
def vector_topk_in_collection(spark, sf_dir):
    mine = _pieces_of_vectors(spark, sf_dir).filter("parent_id = 3")
    return vectors.topk(mine, _vector(spark, sf_dir, 1), 10).select("piece_id", "parent_id", "similarity")


@_query("vector_cutoff", f"WITH {_top(0, 40)} SELECT {_SHOWN} FROM top0 WHERE similarity > 0.2")
def vector_cutoff(spark, sf_dir):
    hits = vectors.above(vectors.topk(_pieces_of_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 40), 0.2)
    return hits.select("piece_id", "parent_id", "similarity")


@_query("vector_normalised", "SELECT vec_id AS piece_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) AS total FROM embeddings")
def vector_normalised(spark, sf_dir):
    unit = _pieces_of_vectors(spark, sf_dir).select("piece_id", vectors.normalised(F.col("embedding")).alias("v"))
    return unit.select("piece_id", _round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@_query(
    "vector_knn_all",
    """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings),
    s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_dot_product(a.u, b.u) AS similarity FROM v a, v b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, neighbour) - 1 AS rank0 FROM s)
    SELECT query, rank0, round(similarity, 5) AS similarity FROM r WHERE rank0 < 5""",
)
def vector_knn_all(spark, sf_dir):
    """The five nearest of every vector."""
    v = _pieces_of_vectors(spark, sf_dir)
    return vectors.knn(v, v, 5).select("query", F.col("rank0").cast("long").alias("rank0"), _round("similarity", 5).alias("similarity"))


@_query("doc_rollup_max", f"WITH {_top(0, 50)} SELECT CAST(parent_id AS BIGINT) AS parent_id, max(similarity) AS best FROM top0 GROUP BY parent_id ORDER BY best DESC, parent_id")
def doc_rollup_max(spark, sf_dir):
    hits = vectors.topk(_pieces_of_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 50)
    return hits.groupBy("parent_id").agg(F.max("similarity").alias("best")).orderBy(F.desc("best"), "parent_id")


@_query(
    "mean_pooling",
    "SELECT parent_id, place, round(avg(x), 6) AS mean FROM (SELECT CAST(label AS BIGINT) AS parent_id, unnest(generate_series(0, 63)) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY parent_id, place",
)
def mean_pooling(spark, sf_dir):
    pooled = vectors.mean_pool(_pieces_of_vectors(spark, sf_dir), "parent_id", 64)
    return pooled.select("parent_id", F.posexplode("embedding").alias("place", "mean")).select("parent_id", F.col("place").cast("long").alias("place"), _round("mean").alias("mean"))


# fusion


def _lists(spark, sf_dir, key: str) -> list[DataFrame]:
    rows = _pieces_of_vectors(spark, sf_dir)
    out = []
    for vec_id in (0, 1, 2)[: 2 if key == "piece_id" else 3]:
        hits = vectors.topk(rows, _vector(spark, sf_dir, vec_id), 40)
        out.append(hits.groupBy(F.col(key).alias("id")).agg(F.max("similarity").alias("score")))
    return out


def _lists_sql(key: str) -> str:
    ids = (0, 1, 2)[: 2 if key == "piece_id" else 3]
    tops = ", ".join(_top(v, 40) for v in ids)
    long = " UNION ALL ".join(f"SELECT {i} AS list_no, {key} AS id, max(similarity) AS score FROM top{v} GROUP BY {key}" for i, v in enumerate(ids))
    return f"WITH {tops}, long AS ({long}), ranked AS (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY score DESC, id) - 1 AS r, min(score) OVER (PARTITION BY list_no) AS lo, max(score) OVER (PARTITION BY list_no) AS hi FROM long)"


def _fused(d: DataFrame) -> DataFrame:
    return d.select(F.col("id").cast("long").alias("id"), _round("fused").alias("fused"))


for _name, _key in (("pieces", "piece_id"), ("docs", "parent_id")):
    _n = 2 if _key == "piece_id" else 3
    _query(f"fusion_rrf_{_name}", _lists_sql(_key) + " SELECT CAST(id AS BIGINT) AS id, round(sum(1.0 / (60.0 + r)), 6) AS fused FROM ranked GROUP BY id")(
        lambda spark, sf_dir, key=_key: _fused(fusion.fuse(_lists(spark, sf_dir, key)))
    )
    _query(f"fusion_rsf_{_name}", _lists_sql(_key) + f" SELECT CAST(id AS BIGINT) AS id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END / {_n}.0), 6) AS fused FROM ranked GROUP BY id")(
        lambda spark, sf_dir, key=_key: _fused(fusion.fuse(_lists(spark, sf_dir, key), fusion.RELATIVE))
    )

# full text


def _tokens_sql(expr: str) -> str:
    return f"regexp_extract_all(translate(lower({expr}), '{MARKED}', '{BARE}'), '{WORD}')"


def _bm25_sql(rows: str, text: str, asked: list[str], match: str, name: str, limit: int | None = None, restrict: str = "true") -> str:
    """CTEs ending in one of that name: the columns of rows and rank."""
    f = [f"f{i}" for i in range(len(asked))]
    counts = ", ".join(f"CAST(len(list_filter(tokens, lambda t: t = '{w}')) AS DOUBLE) AS {c}" for w, c in zip(asked, f))
    df = ", ".join(f"sum(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END) AS d{c}" for c in f)
    idf = lambda c: f"(CASE WHEN ln((n - d{c} + 0.5) / (d{c} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{c} + 0.5) / (d{c} + 0.5)) END)"
    score = " + ".join(f"{idf(c)} * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * size / avg_size))" for c in f)
    hit = (" AND " if match == lexical.ALL else " OR ").join(f"{c} > 0" for c in f)
    cut = f" ORDER BY rank, id LIMIT {limit}" if limit is not None else ""
    return f"""{name}_t AS (SELECT *, {text} AS tokens FROM ({rows})), {name}_c AS (SELECT *, CAST(len(tokens) AS DOUBLE) AS size, {counts} FROM {name}_t),
      {name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(size) AS avg_size, {df} FROM {name}_c),
      {name} AS (SELECT c.*, -({score}) AS rank FROM {name}_c c, {name}_s WHERE ({hit}) AND {restrict}{cut})"""


DOCUMENTS_SQL = "SELECT doc_id AS id, source || '-' || doc_id AS title, split_part(text, chr(10), 1) AS description, text FROM documents"
_TITLE_TOKENS = f"list_concat({_tokens_sql('title')}, {_tokens_sql('description')})"
_HITS = "SELECT id, round(rank, 6) AS rank FROM hits"
ASKED = {"all": "the and", "any": "ingthe queou lichen", "within": "the that with", "title": "src1 the"}


def _lexical(columns, match, **more):
    return lambda spark, sf_dir, asked: lexical.search(document_rows(spark, sf_dir), asked, columns, match, stemmed=False, **more).select("id", _round("rank").alias("rank"))


@_query("lexical_all", f"WITH {_bm25_sql(DOCUMENTS_SQL, _tokens_sql('text'), ASKED['all'].split(), 'all', 'hits')} {_HITS}")
def lexical_all(spark, sf_dir):
    return _lexical(["text"], lexical.ALL)(spark, sf_dir, ASKED["all"])


@_query("lexical_any", f"WITH {_bm25_sql(DOCUMENTS_SQL, _tokens_sql('text'), ASKED['any'].split(), 'any', 'hits')} {_HITS}")
def lexical_any(spark, sf_dir):
    return _lexical(["text"], lexical.ANY)(spark, sf_dir, ASKED["any"])


@_query("lexical_title_description", f"WITH {_bm25_sql(DOCUMENTS_SQL, _TITLE_TOKENS, ASKED['title'].split(), 'all', 'hits', 20)} {_HITS}")
def lexical_title_description(spark, sf_dir):
    return _lexical(["title", "description"], lexical.ALL, limit=20)(spark, sf_dir, ASKED["title"])


@_query("lexical_any_in_document", f"WITH {_bm25_sql(CONVERSATION_PIECES, _tokens_sql('text_content'), ASKED['within'].split(), 'any', 'hits', None, 'parent_id = 7')} {_HITS}")
def lexical_any_in_document(spark, sf_dir):
    _, pieces = conversation_rows(spark, sf_dir)
    return lexical.search(pieces, ASKED["within"], ["text_content"], lexical.ANY, stemmed=False, restrict=F.col("parent_id") == 7).select("id", _round("rank").alias("rank"))


@_query("lexical_postings", f"WITH {_bm25_sql(DOCUMENTS_SQL, _tokens_sql('text'), ASKED['any'].split(), 'any', 'hits', 20)} {_HITS}")
def lexical_postings(spark, sf_dir):
    """The same ranking from an inverted index."""
    rows = document_rows(spark, sf_dir)
    index = lexical.index(rows, ["text"], ["id"], stemmed=False)
    return lexical.search_index(index, ASKED["any"], ["id"], lexical.ANY, 20, stemmed=False).select("id", _round("rank").alias("rank"))


def _forms_of(word: str) -> list[str]:
    """The words that have the word's stem, by trying the endings that stemming takes off: a mapping table for the SQL."""
    s = stem(word)
    ends = ["", "e", "y", *[a + b for a in ("", "e", "i", s[-1], s[-1] + "e") for b in "s es ed ing er ers ings ly ness ful less able ment ments al ally ive ize ized izing ation ence ance ous ism ist".split()]]
    return sorted({w for w in (s + x for x in ends) if stem(w) == s})


def _stemmed_sql(asked: list[str]) -> str:
    tokens = f"list_transform({_tokens_sql('text')}, lambda t: {' '.join(['CASE', *[f'WHEN list_contains({_forms_of(w)}, t) THEN {stem(w)!r}' for w in asked], 'ELSE t END'])})"
    return f"WITH {_bm25_sql(DOCUMENTS_SQL, tokens, [stem(w) for w in asked], 'any', 'hits')} {_HITS}"


@_query("lexical_stemmed", _stemmed_sql(["things", "with"]))
def lexical_stemmed(spark, sf_dir):
    """Tested against an FTS5 table too."""
    return lexical.search(document_rows(spark, sf_dir), "things with", ["text"], lexical.ANY).select("id", _round("rank").alias("rank"))


@_query(
    "corpus_stats",
    f"WITH t AS (SELECT {_tokens_sql('text')} AS tokens FROM documents) SELECT (SELECT count(*) FROM t) AS n_rows, round((SELECT avg(len(tokens)) FROM t), 6) AS avg_len, (SELECT CAST(sum(len(tokens)) AS BIGINT) FROM t) AS n_tokens, (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM t)) AS n_distinct",
)
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(document_rows(spark, sf_dir), ["text"]).withColumn("avg_len", _round("avg_len"))


@_query("document_frequency", f"SELECT token, count(*) AS n_rows FROM (SELECT unnest(list_distinct({_tokens_sql('text')})) AS token FROM documents) GROUP BY token")
def document_frequency(spark, sf_dir):
    return lexical.document_frequency(document_rows(spark, sf_dir), ["text"])


# reads


def _shown(pieces: DataFrame) -> DataFrame:
    return pieces.select("id", "parent_id", "text_content", F.col("sequence_index").cast("long").alias("sequence_index"))


def _read_sql(where: str) -> str:
    return f"WITH d AS ({CONVERSATION_DOCS}), p AS ({CONVERSATION_PIECES}) SELECT p.id, p.parent_id, p.text_content, CAST(p.sequence_index AS BIGINT) AS sequence_index FROM p JOIN d ON p.parent_id = d.id WHERE {where} ORDER BY p.sequence_index, p.id"


@_query("read_piece", _read_sql("d.uuid = md5('3') AND p.sequence_index = 1") + " LIMIT 1")
def read_piece(spark, sf_dir):
    import hashlib

    return _shown(reads.read_piece(*conversation_rows(spark, sf_dir), hashlib.md5(b"3").hexdigest(), 1))


@_query("read_context", _read_sql("d.title = 'conversation 5' AND p.sequence_index >= 1 AND p.sequence_index < 4"))
def read_context(spark, sf_dir):
    return _shown(reads.read_context(*conversation_rows(spark, sf_dir), "conversation 5", 2, 1, 2))


@_query("read_range", _read_sql("d.title = 'conversation 6' AND p.sequence_index >= 0 AND p.sequence_index < 3"))
def read_range(spark, sf_dir):
    return _shown(reads.read_range(*conversation_rows(spark, sf_dir), "conversation 6", 0, 3))


@_query("read_document", _read_sql("d.title = 'conversation 2'"))
def read_document(spark, sf_dir):
    return _shown(reads.pieces_of(*conversation_rows(spark, sf_dir), title="conversation 2"))


_NESTED = "SELECT d.id, d.title, CAST(count(p.id) AS BIGINT) AS n_pieces, string_agg(p.text_content, '|' ORDER BY p.sequence_index, p.id) AS texts FROM d LEFT JOIN p ON p.parent_id = d.id"


def _nested(d: DataFrame) -> DataFrame:
    return d.select("id", "title", F.size("pieces").cast("long").alias("n_pieces"), F.array_join(F.col("pieces.text_content"), "|").alias("texts"))


@_query("read_documents", f"WITH d AS ({CONVERSATION_DOCS}), p AS ({CONVERSATION_PIECES}) {_NESTED} WHERE d.uuid IN (md5('1'), md5('4'), md5('9')) GROUP BY d.id, d.title")
def read_documents(spark, sf_dir):
    import hashlib

    return _nested(reads.read_documents(*conversation_rows(spark, sf_dir), [hashlib.md5(x).hexdigest() for x in (b"1", b"4", b"9")]))


@_query("read_all_documents", f"WITH d AS ({CONVERSATION_DOCS}), p AS ({CONVERSATION_PIECES}) {_NESTED} GROUP BY d.id, d.title")
def read_all_documents(spark, sf_dir):
    return _nested(reads.read_documents(*conversation_rows(spark, sf_dir)))


@_query("piece_count", "SELECT count(*) AS n_pieces FROM conversations")
def piece_count(spark, sf_dir):
    return reads.piece_count(conversation_rows(spark, sf_dir)[1])


# chunks


def _chunks_sql(context: int, prefix: str, rows: str = "documents") -> str:
    """Chunk after chunk by recursion: st is the first sentence of a chunk, least the sentence up to which it goes at least."""
    room = f"greatest({context} - length({prefix}), 1)"
    return f"""WITH RECURSIVE s AS (
      SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text, {prefix} AS prefix, {room} AS room, CAST(floor({room} * 0.05) AS BIGINT) AS overlap,
        list_filter(regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '[^.!?\\n]*(?:[.!?]+[ \\t\\r\\n\\f]*|\\n|$)'), lambda x: length(x) > 0) AS parts FROM {rows}),
    p AS (SELECT doc_id, text, prefix, room, overlap, list_prepend(0, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))))) AS run FROM s WHERE len(parts) > 0 AND len(parts) <= 1500
      UNION ALL SELECT doc_id, text, prefix, room, overlap, run FROM (
        SELECT doc_id, list(x ORDER BY i) AS run FROM (SELECT doc_id, i, sum(CASE WHEN i = 0 THEN 0 ELSE length(parts[i]) END) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM (SELECT doc_id, parts, unnest(range(0, len(parts) + 1)) AS i FROM s WHERE len(parts) > 1500)) GROUP BY doc_id) JOIN s USING (doc_id)),
    c AS (SELECT doc_id, 1 AS step, 0 AS st, 1 AS least, greatest(1, len(list_filter(run, lambda x: x <= room)) - 1) AS fin FROM p
      UNION ALL
      SELECT n.doc_id, n.step, n.st, n.least, greatest(n.least, len(list_filter(p.run, lambda x: x <= p.run[n.st + 1] + p.room)) - 1) FROM (
        SELECT c.doc_id, c.step + 1 AS step, greatest(c.st, len(list_filter(p.run[1:c.fin + 1], lambda x: x < p.run[c.fin + 1] - p.overlap))) AS st, c.fin + 1 AS least
        FROM c JOIN p USING (doc_id) WHERE c.fin < len(p.run) - 1) n JOIN p USING (doc_id)),
    t AS (SELECT doc_id, step, prefix, run[st + 1] AS a, substr(text, CAST(run[st + 1] AS BIGINT) + 1, CAST(run[fin + 1] - run[st + 1] AS BIGINT)) AS piece FROM c JOIN p USING (doc_id)),
    u AS (SELECT doc_id, step, prefix, a + length(piece) - length(ltrim(piece, ' ' || chr(9) || chr(10) || chr(13))) AS lower, trim(piece, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM t)
    SELECT doc_id, prefix || body AS text_content, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS sequence_index, count(*) OVER (PARTITION BY doc_id) AS document_length, CAST(lower AS BIGINT) AS lower, CAST(lower + length(body) AS BIGINT) AS upper
    FROM u WHERE length(body) > 0"""


def _chunks(spark, sf_dir, context: int, prefix: Column | None = None) -> DataFrame:
    c = chunking.sentence_chunks(_table(spark, sf_dir, "documents"), context_size=context, prefix=prefix)
    long = lambda x: F.col(x).cast("long")
    return c.select("doc_id", "text_content", long("sequence_index").alias("sequence_index"), long("document_length").alias("document_length"), long("anchor.char_range.lower").alias("lower"), long("anchor.char_range.upper").alias("upper"))


@_query("sentence_chunks", _chunks_sql(512, "''"))
def sentence_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, 512)


@_query("sentence_chunks_prefixed", _chunks_sql(300, "source || ': '"))
def sentence_chunks_prefixed(spark, sf_dir):
    return _chunks(spark, sf_dir, 300, F.concat("source", F.lit(": ")))


@_query(
    "paged_chunks",
    f"""SELECT doc_id // 1000 AS doc_id, doc_id % 1000 AS page, text_content, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id, sequence_index) - 1 AS sequence_index,
      count(*) OVER (PARTITION BY doc_id // 1000) AS document_length, lower, upper FROM ({_chunks_sql(60, "''", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")})""",
)
def paged_chunks(spark, sf_dir):
    """Turns as the pages of a document, numbered over all of them."""
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    long = lambda x: F.col(x).cast("long")
    out = paged.paged_chunks(c, context_size=60)
    return out.select("doc_id", long("page").alias("page"), "text_content", long("sequence_index").alias("sequence_index"), long("document_length").alias("document_length"), long("anchor.char_range.lower").alias("lower"), long("anchor.char_range.upper").alias("upper"))


@_query("section_chunks_html")
def section_chunks_html(spark, sf_dir):
    """Pages by header; tests hold the walker against written pages."""
    c = digest_html_column(_table(spark, sf_dir, "pages"))
    return c.select("page_id", "content_type", "text_content", "sequence_index", "document_length", describe_anchor(F.col("anchor")).alias("anchor"))


@_query("basic_tokens", rf"SELECT doc_id, len(regexp_extract_all(text, '[\p{{P}}!-/:-@\[-`{{-~]|[^\s\p{{P}}!-/:-@\[-`{{-~]+')) AS n_tokens FROM documents")
def basic_token_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(basic_tokens(pad_ideographs(clean_text(F.col("text"))))).cast("long").alias("n_tokens"))


@_query("token_encode")
def token_encode(spark, sf_dir):
    """Word pieces with a vocabulary of single characters and a few suffixes."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    pieces = [bert.CLS, bert.SEP, bert.UNK, *letters, *("##" + c for c in letters), *".,:;!?()\"'-|$%&#*+=@/", "##ing", "##er", "the", "de"]
    e = bert.encode(F.col("text"), bert.load_vocabulary(pieces), max_length=128)
    return _table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", F.col("e.input_ids").alias("input_ids"), F.col("e.attention_mask").alias("attention_mask"))


# hybrid search

DIMENSION = 64


def _embedding_sql(rows: str, text: str, name: str) -> str:
    """CTE of (piece_id, parent_id, place, x): places of unit vectors that aren't 0."""
    h = "md5(w)"
    return f"""{name}_w AS (SELECT id, parent_id, unnest({_tokens_sql(text)}) AS w FROM ({rows})),
      {name}_v AS (SELECT id, any_value(parent_id) AS parent_id, CAST('0x' || substr({h}, 1, 8) AS BIGINT) % {DIMENSION} AS place, CAST(sum(CASE WHEN substr({h}, 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM {name}_w GROUP BY id, place),
      {name} AS (SELECT id, parent_id, place, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {name}_v WHERE x <> 0)"""


def _fuse_sql(ranking: str, lists: int) -> str:
    return "sum(1.0 / (60.0 + r))" if ranking == fusion.RECIPROCAL else f"sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END / {lists}.0)"


_IN_LIST = "row_number() OVER (PARTITION BY l ORDER BY score DESC, id) - 1 AS r, min(score) OVER (PARTITION BY l) AS lo, max(score) OVER (PARTITION BY l) AS hi"


def _hybrid_sql(docs: str, pieces: str, text: str, query: str, n: int, cutoff: float, within: int | None = None, ranking: str = fusion.RECIPROCAL, explain: bool = False) -> str:
    asked = query.split()
    mine = "true" if within is None else f"parent_id = {within}"
    limit = f"(SELECT least({2 * n}, count(*)) FROM ({pieces}) WHERE {mine})"
    head = f"""WITH {_embedding_sql(pieces, text, "e")}, {_embedding_sql(f"SELECT 0 AS id, 0 AS parent_id, '{query}' AS q", "q", "q")},
      sim AS (SELECT p.id, p.parent_id, coalesce(round(s.similarity, 7), 0) AS similarity FROM ({pieces}) p LEFT JOIN (SELECT e.id, sum(e.x * q.x) AS similarity FROM e JOIN q USING (place) GROUP BY e.id) s ON s.id = p.id WHERE {mine}),
      sem AS (SELECT * FROM (SELECT * FROM sim ORDER BY similarity DESC, id LIMIT {limit}) WHERE similarity > {cutoff}),
      {_bm25_sql(pieces, _tokens_sql(text), asked, "all" if within is None else "any", "lp", None, mine)}, lex AS (SELECT id, parent_id, -rank AS score FROM lp ORDER BY rank, id LIMIT {limit}),
      pl AS (SELECT 0 AS l, id, similarity AS score FROM sem UNION ALL SELECT 1, id, score FROM lex),
      pr AS (SELECT id, {_fuse_sql(ranking, 2)} AS fused FROM (SELECT *, {_IN_LIST} FROM pl) GROUP BY id),
      pk AS (SELECT id, row_number() OVER (ORDER BY round(fused, 12) DESC, id) - 1 AS g FROM pr)"""
    if within is not None:
        return head + f" SELECT g AS piece_rank, id AS piece_id FROM pk WHERE g < {n}"
    more = ", round(dk.fused, 6) AS document_score, sem.similarity, round(lex.score, 6) AS lexical_score, round(tl.score, 6) AS title_score, (SELECT count(*) FROM sem) AS n_semantic, (SELECT count(*) FROM lex) AS n_lexical, (SELECT count(*) FROM tl) AS n_title"
    join = "LEFT JOIN sem ON sem.id = sp.id LEFT JOIN lex ON lex.id = sp.id LEFT JOIN tl ON tl.id = dk.id"
    return (
        head
        + f""", {_bm25_sql(docs, _TITLE_TOKENS, asked, "all", "ld")}, tl AS (SELECT id, -rank AS score FROM ld ORDER BY rank, id LIMIT {limit}),
      dl AS (SELECT 0 AS l, parent_id AS id, max(similarity) AS score FROM sem GROUP BY parent_id UNION ALL SELECT 1, parent_id, max(score) FROM lex GROUP BY parent_id UNION ALL SELECT 2, id, score FROM tl),
      dr AS (SELECT id, {_fuse_sql(ranking, 3)} AS fused FROM (SELECT *, {_IN_LIST} FROM dl) GROUP BY id),
      dk AS (SELECT id, fused, row_number() OVER (ORDER BY round(fused, 12) DESC, id) - 1 AS g FROM dr),
      sp AS (SELECT id, parent_id FROM sem UNION SELECT id, parent_id FROM lex)
      SELECT dk.g AS document_rank, dk.id AS document_id, sp.id AS piece_id, CASE WHEN sp.id IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY dk.id ORDER BY pk.g) - 1 END AS piece_rank{more if explain else ""}
      FROM dk LEFT JOIN sp ON sp.parent_id = dk.id LEFT JOIN pk ON pk.id = sp.id {join if explain else ""} WHERE dk.g < {n}"""
    )


def _embedded(pieces: DataFrame, text: str) -> DataFrame:
    return pieces.select(F.col("id").alias("piece_id"), "parent_id", embed_column(F.col(text), HashingProvider(DIMENSION)).alias("embedding"))


def _ask(query: str) -> list[float]:
    return HashingProvider(DIMENSION).embed_query(normalise_query(query))


@_query("hybrid_search", _hybrid_sql(CONVERSATION_DOCS, CONVERSATION_PIECES, "text_content", "the and", 10, 0.2))
def hybrid_search(spark, sf_dir):
    documents, pieces = conversation_rows(spark, sf_dir)
    found = hybrid.search(documents, pieces, _embedded(pieces, "text_content"), "the and", _ask("the and"), 10, 0.2, stemmed=False)
    return found.select("document_rank", "document_id", "piece_id", "piece_rank")


@_query("hybrid_search_in_document", _hybrid_sql(CONVERSATION_DOCS, CONVERSATION_PIECES, "text_content", "the that with", 5, 0.05, 7))
def hybrid_search_in_document(spark, sf_dir):
    _, pieces = conversation_rows(spark, sf_dir)
    found = hybrid.search_within(pieces, _embedded(pieces, "text_content"), 7, "the that with", _ask("the that with"), 5, 0.05, stemmed=False)
    return found.select("piece_rank", "piece_id")


@_query("hybrid_search_explained", _hybrid_sql(CONVERSATION_DOCS, CONVERSATION_PIECES, "text_content", "the and", 10, 0.2, ranking=fusion.RELATIVE, explain=True))
def hybrid_search_explained(spark, sf_dir):
    """By relative scores, with what led there."""
    documents, pieces = conversation_rows(spark, sf_dir)
    found = hybrid.search(documents, pieces, _embedded(pieces, "text_content"), "the and", _ask("the and"), 10, 0.2, fusion.RELATIVE, stemmed=False, explain=True)
    scores = [_round(c).alias(c) for c in ("document_score", "lexical_score", "title_score")]
    return found.select("document_rank", "document_id", "piece_id", "piece_rank", "similarity", *scores, "n_semantic", "n_lexical", "n_title")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search where each document of the documents table is one piece."""
    rows = document_rows(spark, sf_dir)
    pieces = rows.select("id", F.col("id").alias("parent_id"), F.col("text").alias("text_content"))
    return hybrid.search(rows, pieces, _embedded(pieces, "text_content"), "the and", _ask("the and"), 10, 0.1, stemmed=False)


FLAGSHIP = flagship


@_query("hybrid_search_documents", _hybrid_sql(DOCUMENTS_SQL, "SELECT doc_id AS id, doc_id AS parent_id, text AS text_content FROM documents", "text_content", "the and", 10, 0.1))
def hybrid_search_documents(spark, sf_dir):
    return flagship(spark, sf_dir).select("document_rank", "document_id", "piece_id", "piece_rank")

# smaller operators


@_query("surfaced_pieces", f"WITH {_top(0, 40)}, {_top(1, 40)} SELECT piece_id FROM top0 UNION SELECT piece_id FROM top1")
def surfaced_pieces(spark, sf_dir):
    """Ids of two ranked lists, once each."""
    rows = _pieces_of_vectors(spark, sf_dir)
    a, b = (vectors.topk(rows, _vector(spark, sf_dir, v), 40).select("piece_id") for v in (0, 1))
    return a.union(b).distinct()


@_query("sample_statistics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance, round(stddev_samp(value), 6) AS deviation, round(stddev_samp(value) / avg(value), 6) AS relative FROM events GROUP BY event_type")
def sample_statistics(spark, sf_dir):
    s = statistics.summary(_table(spark, sf_dir, "events"), "value", "event_type")
    return s.select("event_type", "n", _round("mean").alias("mean"), _round("variance", 5).alias("variance"), _round("deviation").alias("deviation"), _round("relative").alias("relative"))


@_query("context_by_window", f"WITH p AS ({CONVERSATION_PIECES}) SELECT id, CAST(count(*) OVER (PARTITION BY parent_id ORDER BY sequence_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n_around FROM p")
def context_by_window(spark, sf_dir):
    """How many pieces stand around each, by place."""
    from pyspark.sql import Window

    _, pieces = conversation_rows(spark, sf_dir)
    around = Window.partitionBy("parent_id").orderBy("sequence_index").rangeBetween(-1, 1)
    return pieces.select("id", F.count("*").over(around).alias("n_around"))


# the store


def _loaded(spark: SparkSession, sf_dir: str, places: bool = True) -> Store:
    """A store of its own with the conversations under their ids."""
    documents, pieces = conversation_rows(spark, sf_dir)
    old = pieces.select("id", F.col("content_type").alias("contentType"), F.col("text_content").alias("textContent"), F.lit(None).cast("binary").alias("dataContent"), F.col("parent_id").alias("parentID"), *([F.col("sequence_index").alias("sequenceIndex")] if places else []))
    store = Store(spark, workspace.folder(spark, "store"), HashingProvider(DIMENSION), stemmed=False)
    store.load_legacy(documents, old)
    return store


def _uuid(conversation: int) -> str:
    import hashlib

    return hashlib.md5(str(conversation).encode()).hexdigest()


@_query("store_search", _hybrid_sql(CONVERSATION_DOCS, CONVERSATION_PIECES, "text_content", "the and", 10, 0.2))
def store_search(spark, sf_dir):
    """By the stored vectors and the stored index."""
    return _loaded(spark, sf_dir).search("the and", 10, 0.2).select("document_rank", "document_id", "piece_id", "piece_rank")


@_query("store_search_within", _hybrid_sql(CONVERSATION_DOCS, CONVERSATION_PIECES, "text_content", "the that with", 5, 0.05, 7))
def store_search_within(spark, sf_dir):
    return _loaded(spark, sf_dir).search_within(_uuid(7), "the that with", 5, 0.05).select("piece_rank", "piece_id")


_AFTER = f"SELECT id, uuid, title, description FROM ({CONVERSATION_DOCS}) WHERE id <> 4"


@_query("store_search_after_changes", _hybrid_sql(f"{_AFTER} UNION ALL SELECT 4, '', 'conversation 4', 'the one and only'", f"SELECT id, parent_id, text_content, sequence_index FROM ({CONVERSATION_PIECES}) WHERE parent_id NOT IN (4, 6) UNION ALL SELECT (SELECT max(id) + 1 FROM ({CONVERSATION_PIECES})), 4, 'the first and the last', 0", "text_content", "the and", 10, 0.2).replace(_AFTER, _AFTER + " AND id <> 6"))
def store_search_after_changes(spark, sf_dir):
    """The index and the vectors follow a change and a deletion."""
    store = _loaded(spark, sf_dir)
    store.update_document(_uuid(4), [{"content_type": 0, "text_content": "the first and the last", "sequence_index": 0, "document_length": 1}], description="the one and only")
    store.delete_document(_uuid(6))
    return store.search("the and", 10, 0.2).select("document_rank", "document_id", "piece_id", "piece_rank")


@_query(
    "legacy_defaults",
    "SELECT conv_id * 1000 + turn AS id, CAST(0 AS BIGINT) AS sequence_index, CAST(1 AS BIGINT) AS document_length, 'characters 0 to ' || length(text) AS anchor FROM conversations",
)
def legacy_defaults(spark, sf_dir):
    """Pieces from before places were stored."""
    d = _loaded(spark, sf_dir, places=False).pieces
    return d.select("id", F.col("sequence_index").cast("long").alias("sequence_index"), F.col("document_length").cast("long").alias("document_length"), describe_anchor(F.col("anchor")).alias("anchor"))


@_query(
    "create_documents",
    f"""WITH d AS (SELECT row_number() OVER (ORDER BY uuid) AS id, id AS old FROM ({CONVERSATION_DOCS}))
    SELECT row_number() OVER (ORDER BY d.id, p.sequence_index) AS id, d.id AS parent_id, p.text_content, CAST(p.sequence_index AS BIGINT) AS sequence_index FROM ({CONVERSATION_PIECES}) p JOIN d ON d.old = p.parent_id""",
)
def create_documents(spark, sf_dir):
    """Documents are numbered by uuid, pieces by document and place."""
    documents, pieces = conversation_rows(spark, sf_dir)
    contents = pieces.join(documents.select(F.col("id").alias("parent_id"), "uuid"), "parent_id").select("uuid", "content_type", "text_content", F.lit(None).cast("binary").alias("data_content"), "sequence_index", F.lit(1).alias("document_length"), F.lit(None).cast(ANCHOR).alias("anchor"))
    store = Store(spark, workspace.folder(spark, "store"), HashingProvider(DIMENSION), stemmed=False)
    store.create_documents(documents, contents)
    return _shown(store.pieces)


@_query("delete_document", f"WITH p AS ({CONVERSATION_PIECES}) SELECT id, parent_id, text_content, CAST(sequence_index AS BIGINT) AS sequence_index FROM p WHERE parent_id <> 4")
def delete_document(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    store.delete_document(_uuid(4))
    return _shown(store.pieces)


@_query(
    "update_document",
    f"WITH p AS ({CONVERSATION_PIECES}), m AS (SELECT max(id) AS m FROM p) SELECT id, parent_id, text_content, CAST(sequence_index AS BIGINT) AS sequence_index FROM p WHERE parent_id <> 4 UNION ALL SELECT m + 1, 4, 'new first', 0 FROM m UNION ALL SELECT m + 2, 4, 'new second', 1 FROM m",
)
def update_document(spark, sf_dir):
    """The document keeps its id, its pieces are replaced under new ids."""
    store = _loaded(spark, sf_dir)
    store.update_document(_uuid(4), [{"content_type": 0, "text_content": f"new {x}", "sequence_index": i, "document_length": 2} for i, x in enumerate(("first", "second"))])
    return _shown(store.pieces)


@_query("reembed", f"WITH {_embedding_sql(CONVERSATION_PIECES, 'text_content', 'e')} SELECT id AS piece_id, CAST(place AS BIGINT) AS place, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x FROM e")
def reembed(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    store.re_embed()
    long = store.embeddings.select("piece_id", F.posexplode("embedding").alias("place", "x")).filter("x <> 0")
    return long.select("piece_id", F.col("place").cast("long").alias("place"), _round(F.col("x").cast("double"), 5).alias("x"))
