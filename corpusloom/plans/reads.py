"""Reads of documents and their pieces; pieces come in order of place, then id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_by(documents: DataFrame, **key) -> DataFrame:
    """By uuid, title or id; no row where there is none."""
    out = documents
    for name, value in key.items():
        out = out.filter(F.col(name) == value)
    return out


def pieces_of(documents: DataFrame, pieces: DataFrame, where: Column | None = None, **key) -> DataFrame:
    """The pieces of one document by place. The document is a row of a filtered scan and is sent to the pieces."""
    one = document_by(documents, **key).select(F.col("id").alias("parent_id"))
    found = pieces if where is None else pieces.filter(where)
    return found.join(F.broadcast(one), "parent_id", "left_semi").orderBy("sequence_index", "id")


def read_piece(documents: DataFrame, pieces: DataFrame, uuid: str, sequence: int) -> DataFrame:
    return pieces_of(documents, pieces, F.col("sequence_index") == sequence, uuid=uuid).limit(1)


def read_range(documents: DataFrame, pieces: DataFrame, title: str, lower: int, upper: int) -> DataFrame:
    """Places from lower up to but not including upper."""
    return pieces_of(documents, pieces, (F.col("sequence_index") >= lower) & (F.col("sequence_index") < upper), title=title)


def read_context(documents: DataFrame, pieces: DataFrame, title: str, sequence: int, before: int, after: int) -> DataFrame:
    """The places around one; the centre counts among those after."""
    return read_range(documents, pieces, title, sequence - before, sequence + after)


def with_pieces(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Documents with the array of their pieces by place, empty where there is none; one shuffle of the pieces by document."""
    fields = [c for c in pieces.columns if c != "parent_id"]
    packed = F.struct("sequence_index", "id", F.struct(*fields).alias("p"))
    nested = pieces.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["p"]).alias("pieces"))
    out = documents.join(nested, documents["id"] == nested["parent_id"], "left").drop("parent_id")
    return out.withColumn("pieces", F.coalesce("pieces", F.array().cast(nested.schema["pieces"].dataType)))


def read_documents(documents: DataFrame, pieces: DataFrame, uuids: list[str] | None = None) -> DataFrame:
    """All documents, or those of the uuids, with their pieces."""
    if uuids is None:
        return with_pieces(documents, pieces)
    some = documents.filter(F.col("uuid").isin(list(uuids)) if uuids else F.lit(False))
    mine = pieces.join(some.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return with_pieces(some, mine)


def piece_count(pieces: DataFrame) -> DataFrame:
    return pieces.agg(F.count("*").alias("n_pieces"))
