"""New files of a folder into a store, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.store import Store
from corpusloom.sources.reader import digest_files
from corpusloom.sources.registry import Options


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """One document a file, its path as title and the path's digest as uuid. A micro-batch that is run again finds its documents there and adds none."""

    def one(batch: DataFrame, _: int) -> None:
        named = batch.select("path", "content", F.md5("path").alias("uuid"))
        new = named.join(store.documents.select("uuid"), "uuid", "left_anti")
        documents = new.select("uuid", F.col("path").alias("title"), F.lit("").alias("description"))
        if documents.limit(1).count():
            contents = digest_files(spark, new, options).withColumn("uuid", F.md5("path")).drop("path")
            store.create_documents(documents, contents)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
