"""Documents given as rows of pages: text pieces numbered over all pages of their document, image pieces for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.chunking import CONTEXT, sentence_chunks
from corpusloom.schema import pdf_anchor


def paged_chunks(pages: DataFrame, key: str = "doc_id", page: str = "page", text: str = "text", context_size: int = CONTEXT) -> DataFrame:
    """key, page, text_content, sequence_index, document_length, anchor. Pages without text are left out; one shuffle by document, of chunks.

    Where a document has no page with text but a row with a null page, that row's text is chunked instead, as of one text.
    """
    rows = pages.select(F.struct(F.col(key).alias("k"), F.col(page).alias("p")).alias("_place"), F.col(text).alias("_page_text"))
    cut = sentence_chunks(rows, "_place", "_page_text", context_size)
    lower, upper = F.col("anchor.char_range.lower"), F.col("anchor.char_range.upper")
    cut = cut.select(
        F.col("_place.k").alias(key), F.col("_place.p").alias(page), "text_content", F.col("sequence_index").alias("_at"),
        F.when(F.col("_place.p").isNotNull(), pdf_anchor(F.col("_place.p"), lower, upper)).otherwise(F.col("anchor")).alias("anchor"),
    )
    of_document = Window.partitionBy(key)
    has_pages = F.max(F.col(page).isNotNull()).over(of_document)
    cut = cut.withColumn("_paged", has_pages).filter(F.col(page).isNotNull() | ~F.col("_paged"))
    order = of_document.orderBy(page, "_at")
    return cut.select(key, page, "text_content", (F.row_number().over(order) - 1).alias("sequence_index"), F.count("*").over(of_document).alias("document_length"), "anchor")


def paged_images(images: DataFrame, key: str = "doc_id", page: str = "page", data: str = "data", label: str | None = None) -> DataFrame:
    """key, page, data_content, text_content (the caption), sequence_index, document_length, anchor; rows without data are left out."""
    of_document = Window.partitionBy(key)
    name = F.col(page).cast("string") if label is None else F.coalesce(F.col(label).cast("string"), F.col(page).cast("string"))
    some = images.filter(F.col(data).isNotNull())
    return some.select(
        key, page, F.col(data).alias("data_content"), F.concat(F.lit("Page "), name, F.lit(" of PDF")).alias("text_content"),
        (F.row_number().over(of_document.orderBy(page)) - 1).alias("sequence_index"), F.count("*").over(of_document).alias("document_length"), pdf_anchor(F.col(page)).alias("anchor"),
    )
