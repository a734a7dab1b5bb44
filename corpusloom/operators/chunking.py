"""Sentence chunks: a text cut at sentence ends and packed into pieces of a context's size, each with its place in the text.

Packing is a fold along the text, so it runs in Arrow batches in Python: each chunk is two binary searches in the running lengths of the
sentences, where a fold in a Column expression would copy its state for every sentence.

Defined results: a null, empty or blank text has no chunk; a sentence longer than the context is a chunk of its own, never split; blank chunks
are dropped and those that are left are numbered without gaps.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.schema import text_anchor

#: Runs up to a mark with the blanks after it, or a line's end; joined, the matches are the text again.
SENTENCE = r"[^.!?\n]*(?:[.!?]+[ \t\r\n\f]*|\n|$)"
OVERLAP = 0.05
CONTEXT = 512
_SENTENCE = re.compile(SENTENCE)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.findall(text) if s]


def chunk_spans(text: str | None, context_size: int, prefix_size: int = 0) -> list[tuple[int, int]]:
    """(lower, upper) of each chunk without the blanks at its ends."""
    if not text or text.isspace():
        return []
    room = max(context_size - prefix_size, 1)
    overlap = int(room * OVERLAP)
    run = [0, *accumulate(map(len, sentences(text)))]
    last = len(run) - 1
    out = []
    first, least = 0, 1  # the chunk begins with sentence first and goes at least up to least (exclusive)
    while True:
        end = max(least, bisect_right(run, run[first] + room) - 1)
        piece = text[run[first] : run[end]]
        lower = run[first] + len(piece) - len(piece.lstrip())
        upper = run[end] - (len(piece) - len(piece.rstrip()))
        if lower < upper:
            out.append((lower, upper))
        if end >= last:
            return out
        first = max(first, bisect_left(run, run[end] - overlap, 0, end + 1))
        least = end + 1


def chunks(text: str | None, context_size: int, prefix: str = "") -> list[tuple[str, int, int]]:
    """(prefix and chunk, lower, upper); places are those in the text itself."""
    return [(prefix + text[a:b], a, b) for a, b in chunk_spans(text, context_size, len(prefix))]


_SPANS = "array<struct<lower:int,upper:int>>"


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", context_size: int = CONTEXT, prefix: str | Column | None = None, sequence_offset: int = 0, anchor_maker: Callable[[Column, Column], Column] = text_anchor) -> DataFrame:
    """key, text_content, sequence_index, document_length, anchor; one row a chunk. The anchor is made of the range's lower and upper bound."""
    head = F.lit("") if prefix is None else F.lit(prefix) if isinstance(prefix, str) else F.coalesce(prefix, F.lit(""))
    rows = docs.select(F.col(key), F.regexp_replace(text, "\r\n", "\n").alias("_text"), head.alias("_head"))

    def run(batches):
        for b in batches:
            at, heads = b.schema.get_field_index("_text"), b.schema.get_field_index("_head")
            spans = [[{"lower": x, "upper": y} for x, y in chunk_spans(t, context_size, len(h))] for t, h in zip(b.column(at).to_pylist(), b.column(heads).to_pylist())]
            yield b.append_column("_spans", pa.array(spans, pa.list_(pa.struct([("lower", pa.int32()), ("upper", pa.int32())]))))

    from pyspark.sql import types as T

    out = T.StructType([*rows.schema.fields, T.StructField("_spans", T._parse_datatype_string(_SPANS))])
    cut = rows.mapInArrow(run, out).select(key, "_text", "_head", F.size("_spans").alias("_n"), F.posexplode("_spans").alias("_at", "_span"))
    lower, upper = F.col("_span.lower"), F.col("_span.upper")
    return cut.select(
        key,
        F.concat("_head", F.substring("_text", lower + 1, upper - lower)).alias("text_content"),
        (F.col("_at") + sequence_offset).alias("sequence_index"),
        F.col("_n").alias("document_length"),
        anchor_maker(lower, upper).alias("anchor"),
    )
