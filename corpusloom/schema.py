"""The data model: documents, pieces, anchors, as explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, IMAGE = 0, 1

CHAR_RANGE = "struct<lower:int,upper:int>"
PLACE = "struct<line:int,column:int>"
ANCHOR = f"struct<kind:string,page:int,char_range:{CHAR_RANGE},text_range:struct<lower:{PLACE},upper:{PLACE}>,selectors:array<string>>"
DOCUMENTS = "id long, uuid string, title string, description string"
PIECES = f"id long, parent_id long, content_type int, text_content string, data_content binary, sequence_index int, document_length int, anchor {ANCHOR}"
CONTENTS = f"content_type int, text_content string, data_content binary, sequence_index int, document_length int, anchor {ANCHOR}"
EMBEDDINGS = "piece_id long, parent_id long, embedding array<float>"


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def anchor(kind: str, page: int | None = None, char_range=None, text_range=None, selectors=None) -> dict:
    """An anchor as a row value; exactly the fields of its kind are set."""
    whole = lambda r: None if r is None else {"lower": r[0], "upper": r[1]}
    places = None
    if text_range is not None:
        places = {k: {"line": p[0], "column": p[1]} for k, p in zip(("lower", "upper"), text_range)}
    return {"kind": kind, "page": page, "char_range": whole(char_range), "text_range": places, "selectors": selectors}


def text_anchor(lower: Column, upper: Column) -> Column:
    span = F.struct(lower.cast("int").alias("lower"), upper.cast("int").alias("upper"))
    return F.struct(
        F.lit("text").alias("kind"),
        F.lit(None).cast("int").alias("page"),
        span.alias("char_range"),
        F.lit(None).cast(f"struct<lower:{PLACE},upper:{PLACE}>").alias("text_range"),
        F.lit(None).cast("array<string>").alias("selectors"),
    ).cast(ANCHOR)


def pdf_anchor(page: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    span = F.lit(None).cast(CHAR_RANGE) if lower is None else F.struct(lower.cast("int").alias("lower"), upper.cast("int").alias("upper"))
    return F.struct(
        F.lit("pdf").alias("kind"),
        page.cast("int").alias("page"),
        span.alias("char_range"),
        F.lit(None).cast(f"struct<lower:{PLACE},upper:{PLACE}>").alias("text_range"),
        F.lit(None).cast("array<string>").alias("selectors"),
    ).cast(ANCHOR)


def describe_anchor(a: Column) -> Column:
    """The printable form; of a PDF place only the page."""
    place = lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["column"].cast("string"))
    return (
        F.when(a["kind"] == "text", F.concat(F.lit("characters "), a["char_range"]["lower"].cast("string"), F.lit(" to "), a["char_range"]["upper"].cast("string")))
        .when(a["kind"] == "location", F.concat(F.lit("from "), place(a["text_range"]["lower"]), F.lit(" to "), place(a["text_range"]["upper"])))
        .when(a["kind"] == "pdf", F.concat(F.lit("page "), a["page"].cast("string")))
        .when(a["kind"] == "selector", F.array_join(a["selectors"], ", "))
    )


def with_defaults(pieces: DataFrame) -> DataFrame:
    """Places of pieces from before places were stored: the whole text of a document of one piece."""
    return pieces.select(
        *[c for c in pieces.columns if c not in ("sequence_index", "document_length", "anchor")],
        F.coalesce("sequence_index", F.lit(0)).cast("int").alias("sequence_index"),
        F.coalesce("document_length", F.lit(1)).cast("int").alias("document_length"),
        F.coalesce("anchor", text_anchor(F.lit(0), F.coalesce(F.length("text_content"), F.lit(0)))).alias("anchor"),
    )


def valid_pieces(pieces: DataFrame) -> DataFrame:
    """Fails, when it runs, on a text piece without text, an image without data or an unknown kind."""
    ok = (
        F.when(F.col("content_type") == TEXT, F.when(F.col("text_content").isNull(), F.raise_error(F.lit("a text piece has no text"))).otherwise(F.lit(True)))
        .when(F.col("content_type") == IMAGE, F.when(F.col("data_content").isNull(), F.raise_error(F.lit("an image piece has no data"))).otherwise(F.lit(True)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of content "), F.coalesce(F.col("content_type").cast("string"), F.lit("null")))))
    )
    return pieces.filter(ok.cast("boolean"))
