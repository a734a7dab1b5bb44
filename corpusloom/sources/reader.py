"""Files of any supported type as content rows: a distributed read, digested where the bytes are."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schema import CONTENTS, schema
from corpusloom.sources.markup import digest_markup
from corpusloom.sources.registry import EXTENSIONS, Options, source_for, type_of, validate


def _arrow(t: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(t)


def digest_files(spark: SparkSession, files: DataFrame, options: Options | None = None) -> DataFrame:
    """files: path, content (as of the binaryFile source). Rows: path and the content columns; a file of an unsupported type fails."""
    options = options or Options()
    out = T.StructType([T.StructField("path", T.StringType()), *schema(CONTENTS).fields])
    kinds = _arrow(out)

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind = type_of(path)
                rows = source_for(kind).digest(path, kind, data or b"", options)
                if rows:
                    yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in rows], kinds)

    return files.select("path", "content").mapInArrow(run, out)


def read_files(spark: SparkSession, path: str | list[str], options: Options | None = None) -> DataFrame:
    """All supported files below a folder or of a pattern."""
    known = "*.{" + ",".join(sorted(k for k, t in EXTENSIONS.items() if _readable(t, options))) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", known).load(path)
    return digest_files(spark, files, options)


def _readable(kind: str, options: Options | None) -> bool:
    from corpusloom.errors import NoAvailableSource

    try:
        s = source_for(kind)
    except NoAvailableSource:
        return False
    return s.name != "pdf" or (options is not None and options.pdf is not None)


def digest_file(path: str, options: Options | None = None) -> list[dict]:
    """One local file, checked first; its content rows."""
    local = validate(path)
    kind = type_of(local)
    source = source_for(kind)
    validate(local, source.kinds)
    with open(local, "rb") as f:
        return source.digest(local, kind, f.read(), options or Options())


def digest_html_column(pages: DataFrame, key: str = "page_id", html: str = "html", context_size: int = 512) -> DataFrame:
    """The same for sources in a column: key and the content columns. Images aren't loaded."""
    rows = pages.select(F.col(key), F.col(html))
    out = T.StructType([rows.schema.fields[0], *schema(CONTENTS).fields])
    kinds = _arrow(out)

    def run(batches):
        for b in batches:
            found = [{key: k, **r} for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in digest_markup(h, context_size)]
            if found:
                yield pa.RecordBatch.from_pylist(found, kinds)

    return rows.mapInArrow(run, out)
