"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in one process (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    now = jsc.getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Bytes of a row group of a temporary table, which a task holds while it writes.
ROW_GROUP = 32 << 20


class Scratch:
    """Written tables under the shared folder: they cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_key(*cols: str) -> Column:
    """128-bit key of a row from the named columns, as two 64-bit hashes (``ROW_KEY``); nulls count as values of their own."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


ROW_KEY = "struct<a:bigint,b:bigint>"
#: A table of keys with at most so many rows is sent to every worker (some 50 MB); a larger one is shuffled.
SMALL_ROWS = 500_000


def sent_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The table, which must be a written one, marked to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_column(schema: T.StructType, *fields: tuple[str, str]) -> T.StructType:
    extra = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    return T.StructType([*schema.fields, *extra])


def normal_key(name: str) -> Column:
    """A grouping key that tells null from every string, and that can be joined with others without two pairs becoming one."""
    s = F.col(name).cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have, whatever its further columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
