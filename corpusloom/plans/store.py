"""A store of documents, pieces and vectors: a folder of Parquet batches and a manifest.

Writes append: every change is a batch of new rows and of tombstones, and becomes visible when the next manifest appears, all of it or nothing. A
change costs what it changes and not what is stored; ``compact`` rewrites the tables without what is dead. Ids are never used again. Changes to one
document are made in the order they were asked for.
"""

from __future__ import annotations

import json
import threading
import time
import uuid as uuids
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.errors import DocumentNotFound, DuplicateDocument, NoDocuments
from corpusloom.operators import fusion, lexical
from corpusloom.operators.embedding import Provider, embed_column
from corpusloom.operators.vectors import check_dimension, normalised
from corpusloom.plans import reads
from corpusloom.plans import search as hybrid
from corpusloom.plans.keyed import KeyedExecutor
from corpusloom.schema import CONTENTS, DOCUMENTS, EMBEDDINGS, PIECES, schema, valid_pieces, with_defaults

CONTEXT_SIZE = 512
_INDEX = "f long, len int"
TABLES = {
    "documents": DOCUMENTS, "pieces": PIECES, "embeddings": EMBEDDINGS, "postings": f"token string, id long, parent_id long, {_INDEX}", "title_postings": f"token string, id long, {_INDEX}",
    "dead_documents": "id long", "dead_pieces": "id long",
}
_KEY = {"documents": "id", "pieces": "id", "embeddings": "piece_id", "postings": "id", "title_postings": "id"}
_TOMBS = {"documents": "dead_documents", "title_postings": "dead_documents", "pieces": "dead_pieces", "embeddings": "dead_pieces", "postings": "dead_pieces"}
_KEEP = 5  # manifests


class Store:
    def __init__(self, spark: SparkSession, path: str, provider: Provider, stemmed: bool = True):
        """Opens the store in a folder, or makes one; opening again changes nothing, but for a store from before there was an index, which gets one.

        stemmed: whether the index has stems; said when the store is made.
        """
        self.spark, self.path, self.provider = spark, path.rstrip("/"), provider
        self._commit_lock = threading.RLock()
        self._keyed = KeyedExecutor()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._Path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifests"))
        if self._version() == 0:
            self._write_manifest({"version": 1, "next_document": 1, "next_piece": 1, "stemmed": stemmed, "batches": {t: [] for t in TABLES}})
        if "stemmed" not in self._manifest():
            self.index_again(stemmed)

    # manifest

    def _versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._Path(f"{self.path}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _version(self) -> int:
        return max(self._versions(), default=0)

    def _manifest(self) -> dict:
        stream = self._fs.open(self._Path(f"{self.path}/manifests/{self._version():012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_manifest(self, m: dict) -> None:
        """Written aside and renamed; a rename onto a version that is there fails, so of two writers one loses."""
        name = f"{self.path}/manifests/{m['version']:012d}.json"
        aside = f"{self.path}/manifests/.{uuids.uuid4().hex}"
        out = self._fs.create(self._Path(aside), False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(self._Path(name)) or not self._fs.rename(self._Path(aside), self._Path(name)):
            self._fs.delete(self._Path(aside), False)
            raise RuntimeError("another writer changed the store")
        for v in self._versions()[:-_KEEP]:
            self._fs.delete(self._Path(f"{self.path}/manifests/{v:012d}.json"), False)

    def _append(self, m: dict, table: str, rows: DataFrame, batch: int) -> None:
        folder = f"{table}/b{batch:012d}-{uuids.uuid4().hex[:8]}"
        rows = rows.select(*schema(TABLES[table]).fieldNames()).withColumn("batch", F.lit(batch).cast("long"))
        if table.endswith("postings"):  # by token, so that a search reads the groups of rows that have its tokens
            rows = rows.sortWithinPartitions("token")
        rows.write.parquet(f"{self.path}/{folder}")
        m["batches"][table].append(folder)

    # tables

    def _raw(self, table: str, m: dict) -> DataFrame:
        kind = schema(TABLES[table] + ", batch long")
        folders = [f"{self.path}/{f}" for f in m["batches"].get(table, [])]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def table(self, name: str, m: dict | None = None) -> DataFrame:
        """The live rows: those that no later batch says are dead."""
        m = m or self._manifest()
        rows = self._raw(name, m)
        tombs = _TOMBS.get(name)
        if tombs and m["batches"].get(tombs):
            dead = self._raw(tombs, m).groupBy(F.col("id").alias("_dead")).agg(F.max("batch").alias("_until"))
            rows = rows.join(dead, F.col(_KEY[name]) == F.col("_dead"), "left").filter(F.col("_until").isNull() | (F.col("batch") >= F.col("_until")))
        return rows.select(*schema(TABLES[name]).fieldNames())

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def pieces(self) -> DataFrame:
        return self.table("pieces")

    @property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    # writes

    def _stage(self, mine: list[str], rows: DataFrame) -> DataFrame:
        """The rows written aside, in a folder that is noted among one's own."""
        mine.append(f"{self.path}/staged/{uuids.uuid4().hex}")
        rows.write.parquet(mine[-1])
        return self.spark.read.schema(rows.schema).parquet(mine[-1])

    def _unstage(self, mine: list[str]) -> None:
        for folder in mine:
            self._fs.delete(self._Path(folder), True)

    def _indexed(self, m: dict, pieces: DataFrame | None, documents: DataFrame | None, batch: int) -> None:
        """The index rows of new pieces and documents."""
        if pieces is not None:
            self._append(m, "postings", lexical.index(pieces, ["text_content"], ["id", "parent_id"], m["stemmed"]), batch)
        if documents is not None:
            self._append(m, "title_postings", lexical.index(documents, ["title", "description"], ["id"], m["stemmed"]), batch)

    def index_again(self, stemmed: bool = True) -> None:
        """A new index of all pieces and documents."""
        with self._commit_lock:
            m = self._manifest()
            batch = m["version"] + 1
            m["stemmed"] = stemmed
            m["batches"] |= {"postings": [], "title_postings": []}
            self._indexed(m, self.table("pieces", m), self.table("documents", m), batch)
            self._write_manifest(m | {"version": batch})

    def _numbered(self, rows: DataFrame, start: int, mine: list[str], *order: str) -> DataFrame:
        """With ids from start on in that order; no task sees more than a partition. What rows come from is worked out once."""
        rows = self._stage(mine, rows)  # before the range is sampled
        back = self._stage(mine, rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
        offsets = back.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
        return back.withColumn("_row", inside).join(F.broadcast(offsets.select("_part", "_offset")), "_part").withColumn("id", (F.col("_offset") + F.col("_row") + (start - 1)).cast("long")).drop("_part", "_row", "_offset")

    def _vectors(self, pieces: DataFrame) -> DataFrame:
        texts = pieces.filter("content_type = 0 and text_content is not null")
        found = texts.select(F.col("id").alias("piece_id"), "parent_id", embed_column(F.col("text_content"), self.provider).alias("embedding"))
        return check_dimension(found, self.provider.dimension).withColumn("embedding", normalised(F.col("embedding")).cast("array<float>"))

    def create_documents(self, documents: DataFrame, contents: DataFrame) -> None:
        """documents: uuid, title, description; contents: uuid and the content columns. All or nothing."""
        with self._commit_lock:
            m = self._manifest()
            new = documents.select("uuid", "title", "description")
            for key in ("uuid", "title"):
                taken = new.groupBy(key).count().filter("count > 1").select(key).unionByName(new.select(key).join(self.table("documents", m).select(key), key, "left_semi"))
                if taken.limit(1).count():
                    raise DuplicateDocument(f"a {key} is taken: {taken.first()[0]}")
            mine: list[str] = []
            numbered = self._numbered(new, m["next_document"], mine, "uuid")
            batch = m["version"] + 1
            self._append(m, "documents", numbered, batch)
            written = self.spark.read.parquet(f"{self.path}/{m['batches']['documents'][-1]}")
            m["next_document"] += written.count()
            with_parent = contents.join(written.select("uuid", F.col("id").alias("parent_id")), "uuid")
            pieces = self._numbered(valid_pieces(with_parent), m["next_piece"], mine, "parent_id", "sequence_index")
            self._append(m, "pieces", pieces, batch)
            stored = self.spark.read.parquet(f"{self.path}/{m['batches']['pieces'][-1]}")
            m["next_piece"] += stored.count()
            self._append(m, "embeddings", self._vectors(stored), batch)
            self._indexed(m, stored, written, batch)
            self._write_manifest(m | {"version": batch})
            self._unstage(mine)

    def _contents(self, uuid: str, contents: Iterable[dict]) -> DataFrame:
        names = schema(CONTENTS).fieldNames()
        return self.spark.createDataFrame([(uuid, *[r.get(n) for n in names]) for r in contents], schema("uuid string, " + CONTENTS))

    def create_document(self, uuid: str, title: str, description: str, contents: Iterable[dict]) -> None:
        documents = self.spark.createDataFrame([(uuid, title, description)], "uuid string, title string, description string")
        self._keyed.run(uuid, lambda: self.create_documents(documents, self._contents(uuid, contents)))

    def _update(self, uuid: str, title: str | None, description: str | None, contents: DataFrame) -> None:
        with self._commit_lock:
            m = self._manifest()
            old = self.table("documents", m).filter(F.col("uuid") == uuid).first()
            if old is None:
                raise DocumentNotFound(uuid)
            title = old.title if title is None else title
            if self.table("documents", m).filter((F.col("title") == title) & (F.col("uuid") != uuid)).limit(1).count():
                raise DuplicateDocument(f"a title is taken: {title}")
            batch = m["version"] + 1
            dead = self.table("pieces", m).filter(F.col("parent_id") == old.id).select("id")
            self._append(m, "dead_pieces", dead, batch)
            mine: list[str] = []
            pieces = self._numbered(valid_pieces(contents.withColumn("parent_id", F.lit(old.id).cast("long"))), m["next_piece"], mine, "parent_id", "sequence_index")
            self._append(m, "dead_documents", self.spark.createDataFrame([(old.id,)], "id long"), batch)
            new = self.spark.createDataFrame([(old.id, uuid, title, old.description if description is None else description)], DOCUMENTS)
            self._append(m, "documents", new, batch)
            self._append(m, "pieces", pieces, batch)
            stored = self.spark.read.parquet(f"{self.path}/{m['batches']['pieces'][-1]}")
            m["next_piece"] += stored.count()
            self._append(m, "embeddings", self._vectors(stored), batch)
            self._indexed(m, stored, new, batch)
            self._write_manifest(m | {"version": batch})
            self._unstage(mine)

    def update_document(self, uuid: str, contents: Iterable[dict], title: str | None = None, description: str | None = None) -> None:
        """The document keeps its id; its pieces are new ones."""
        self._keyed.run(uuid, lambda: self._update(uuid, title, description, self._contents(uuid, contents)))

    def delete_document(self, uuid: str) -> None:
        """With its pieces and vectors. An unknown uuid changes nothing."""
        self._keyed.run(uuid, lambda: self.delete_documents([uuid]))

    def delete_documents(self, keys: list[str]) -> None:
        with self._commit_lock:
            m = self._manifest()
            gone = self.table("documents", m).filter(F.col("uuid").isin(list(keys))).select("id")
            if not keys or not gone.limit(1).count():
                return
            batch = m["version"] + 1
            pieces = self.table("pieces", m).join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
            self._append(m, "dead_pieces", pieces, batch)
            self._append(m, "dead_documents", gone, batch)
            self._write_manifest(m | {"version": batch})

    def re_embed(self, provider: Provider | None = None) -> None:
        """New vectors for all pieces, by this model or another."""
        with self._commit_lock:
            self.provider = provider or self.provider
            m = self._manifest()
            batch = m["version"] + 1
            pieces = self.table("pieces", m)
            m["batches"]["embeddings"] = []
            self._append(m, "embeddings", self._vectors(pieces), batch)
            self._write_manifest(m | {"version": batch})

    def compact(self) -> None:
        """Rewrites the tables without dead rows. Old folders stay for readers of older manifests, until ``vacuum``."""
        with self._commit_lock:
            m = self._manifest()
            batch = m["version"] + 1
            new = m | {"version": batch, "batches": {t: [] for t in TABLES}}
            for t in _KEY:
                self._append(new, t, self.table(t, m), batch)
            self._write_manifest(new)

    def vacuum(self, hours: float = 24.0) -> None:
        """Deletes folders that the latest manifest doesn't name and that are older than so many hours: younger ones may be those of a writer at work."""
        with self._commit_lock:
            named = {f for b in self._manifest()["batches"].values() for f in b}
            before = (time.time() - hours * 3600) * 1000
            for t in [*TABLES, "staged"]:
                folder = self._Path(f"{self.path}/{t}")
                if self._fs.exists(folder):
                    for x in self._fs.listStatus(folder):
                        if f"{t}/{x.getPath().getName()}" not in named and x.getModificationTime() < before:
                            self._fs.delete(x.getPath(), True)

    def load_legacy(self, documents: DataFrame, pieces: DataFrame) -> None:
        """Rows from before places were stored (id, contentType, textContent, dataContent, embeddings, parentID): ids stay, vectors are made anew."""
        with self._commit_lock:
            m = self._manifest()
            if any(m["batches"].values()):
                raise DuplicateDocument("the store isn't empty")
            names = {"contentType": "content_type", "textContent": "text_content", "dataContent": "data_content", "parentID": "parent_id", "sequenceIndex": "sequence_index", "documentLength": "document_length", "documentAnchor": "anchor"}
            rows = pieces.drop("embeddings").withColumnsRenamed({k: v for k, v in names.items() if k in pieces.columns})
            kinds = {f.name: f.dataType for f in schema(PIECES)}
            rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
            batch = m["version"] + 1
            self._append(m, "documents", documents, batch)
            self._append(m, "pieces", valid_pieces(with_defaults(rows)), batch)
            stored = self.table("pieces", m)
            for key, table in (("next_document", "documents"), ("next_piece", "pieces")):
                m[key] = (self.table(table, m).agg(F.max("id")).first()[0] or 0) + 1
            self._append(m, "embeddings", self._vectors(stored), batch)
            self._indexed(m, stored, self.table("documents", m), batch)
            self._write_manifest(m | {"version": batch})

    # reads

    def read_piece(self, uuid: str, sequence: int) -> DataFrame:
        return reads.read_piece(self.documents, self.pieces, uuid, sequence)

    def read_piece_context(self, title: str, sequence: int, before: int, after: int) -> DataFrame:
        return reads.read_context(self.documents, self.pieces, title, sequence, before, after)

    def read_range(self, title: str, lower: int, upper: int) -> DataFrame:
        return reads.read_range(self.documents, self.pieces, title, lower, upper)

    def read_document(self, *, title: str | None = None, uuid: str | None = None) -> DataFrame:
        key = {"title": title} if uuid is None else {"uuid": uuid}
        one = reads.document_by(self.documents, **key)
        mine = self.pieces.join(F.broadcast(one.select(F.col("id").alias("parent_id"))), "parent_id", "left_semi")
        return reads.with_pieces(one, mine)

    def read_documents(self, keys: list[str] | None = None) -> DataFrame:
        return reads.read_documents(self.documents, self.pieces, keys)

    def piece_count(self) -> int:
        return self.pieces.count()

    # search

    def search(self, query: str, n_items: int = 10, cutoff: float = hybrid.CUTOFF, ranking: str = fusion.RECIPROCAL, explain: bool = False) -> DataFrame:
        m = self._manifest()
        return hybrid.search(self.table("documents", m), self.table("pieces", m), self.table("embeddings", m), query, self._query_vector(query), n_items, cutoff, ranking, m["stemmed"], explain, True, indexes=(self.table("postings", m), self.table("title_postings", m)))

    def search_within(self, uuid: str, query: str, n_items: int = 10, cutoff: float = hybrid.CUTOFF, ranking: str = fusion.RECIPROCAL, explain: bool = False) -> DataFrame:
        m = self._manifest()
        one = self.table("documents", m).filter(F.col("uuid") == uuid).select("id").first()
        if one is None:
            raise NoDocuments(uuid)
        return hybrid.search_within(self.table("pieces", m), self.table("embeddings", m), one.id, query, self._query_vector(query), n_items, cutoff, ranking, m["stemmed"], explain, True, index=self.table("postings", m))

    def _query_vector(self, query: str) -> list[float]:
        from corpusloom.functions.text import normalise_query

        return self.provider.embed_query(normalise_query(query))
