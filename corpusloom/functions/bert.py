"""Word pieces: normalisation and splitting stay in the JVM; distinct words are cut by the longest match in a vocabulary."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.errors import MissingModelFile
from corpusloom.functions.text import SLICE_ROWS, basic_tokens, clean_text, pad_ideographs, slices

#: Words whose pieces a worker keeps.
KNOWN = 50_000
CLS, SEP, UNK = "[CLS]", "[SEP]", "[UNK]"


@dataclass(frozen=True)
class Configuration:
    dimensions: int = 384
    max_word: int = 100
    clean_text: bool = True
    ideographs: bool = True
    strip_accents: bool | None = None
    lowercase: bool | None = True
    search_prefix: str | None = None

    @property
    def strips(self) -> bool:
        """Accents go where that is said, else where letters are lowered."""
        return bool(self.lowercase) if self.strip_accents is None else self.strip_accents


def _bare(text: str | None) -> str | None:
    return text if text is None or text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@F.arrow_udf(StringType())
def strip_accents(texts: pa.Array) -> pa.Array:
    """Decomposed, without the combining marks."""
    return pa.concat_arrays([pa.array(list(map(_bare, part.to_pylist())), pa.string()) for part in slices(texts)] or [texts])


def normalised_text(text: Column, c: Configuration) -> Column:
    if c.clean_text:
        text = clean_text(text)
    if c.ideographs:
        text = pad_ideographs(text)
    if c.strips:
        text = strip_accents(text)
    return F.lower(text) if c.lowercase else text


def load_vocabulary(lines: list[str]) -> dict[str, int]:
    """A token's id is its line; a blank last line doesn't count."""
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    vocabulary = {t.rstrip("\r\n"): i for i, t in enumerate(lines)}
    for t in (CLS, SEP, UNK):
        if t not in vocabulary:
            raise MissingModelFile(f"the vocabulary has no {t}")
    return vocabulary


def load_folder(folder: str) -> tuple[dict[str, int], Configuration]:
    """vocab.txt and config.json of a model's folder."""
    paths = [os.path.join(folder, n) for n in ("vocab.txt", "config.json")]
    for p in paths:
        if not os.path.isfile(p):
            raise MissingModelFile(p)
    with open(paths[0], encoding="utf-8") as f:
        vocabulary = load_vocabulary(f.read().split("\n"))
    with open(paths[1], encoding="utf-8") as f:
        raw = json.load(f)
    names = {"dimensions": "dimensions", "maximumInputCharactersPerWord": "max_word", "cleanText": "clean_text", "handleChineseCharacters": "ideographs", "stripAccents": "strip_accents", "lowercase": "lowercase", "searchPrefix": "search_prefix"}
    return vocabulary, Configuration(**{names[k]: v for k, v in raw.items() if k in names})


def word_pieces(word: str, vocabulary: dict[str, int], max_word: int = 100) -> list[str]:
    if len(word) > max_word:
        return [UNK]
    out, start = [], 0
    while start < len(word):
        end = len(word)
        while end > start:
            piece = ("##" if start else "") + word[start:end]
            if piece in vocabulary:
                break
            end -= 1
        if end == start:
            return [UNK]
        out.append(piece)
        start = end
    return out


def encode(text: Column, vocabulary: dict[str, int], c: Configuration | None = None, max_length: int | None = None) -> Column:
    """struct(input_ids, attention_mask): the first pieces up to max_length (the dimension by default) between the marks."""
    c = c or Configuration()
    most = max(2, max_length or c.dimensions)
    cls, sep, unk = vocabulary[CLS], vocabulary[SEP], vocabulary[UNK]

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        for words in batches:
            flat, ends = array("i"), [0]
            for at in range(0, len(words), SLICE_ROWS):
                for row in words.slice(at, SLICE_ROWS).to_pylist():
                    mine: list[int] = []
                    for w in row or ():
                        got = known.get(w)
                        if got is None:
                            got = [vocabulary.get(p, unk) for p in word_pieces(w, vocabulary, c.max_word)]
                            if len(known) < KNOWN:
                                known[w] = got
                        mine += got
                        if len(mine) >= most - 2:
                            break
                    flat.append(cls)
                    flat.extend(mine[: most - 2])
                    flat.append(sep)
                    ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32), pa.int32()))

    # each word has a piece at least, and one that is too long has the same piece however long it is: no more of the text bears on the result
    words = F.slice(basic_tokens(normalised_text(text, c)), 1, most - 2) if most > 2 else F.array().cast("array<string>")
    found = ids(F.transform(words, lambda w: F.substring(w, 1, c.max_word + 1)))
    return F.struct(found.alias("input_ids"), F.array_repeat(F.lit(1), F.size(found)).alias("attention_mask"))


def query_text(text: str, c: Configuration) -> str:
    return (c.search_prefix or "") + text
