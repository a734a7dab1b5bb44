"""Embedding models as plug-ins, and one that needs no model."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusloom.errors import CouldNotEmbed
from corpusloom.functions.text import WORD, fold_query, slices
from corpusloom.schema import TEXT


#: Words whose digests a worker keeps.
KNOWN = 100_000
_NOT_WORD = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


class Provider(ABC):
    """A model: its dimension and language, and vectors for batches of texts. Loaded once a worker, in ``load``."""

    dimension: int
    language: str = "en"

    def load(self) -> None:
        """Called before the first batch, on the worker."""

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]:
        self.load()
        return self.embed([text])[0]


class HashingProvider(Provider):
    """Counts of words, each in the place and with the sign that its digest gives, as a unit vector; the same on every machine."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {"dimension": self.dimension, "known": {}}

    def _place(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            h = hashlib.md5(word.encode()).digest()
            got = (int.from_bytes(h[:4], "big") % self.dimension, 1.0 if h[4] < 128 else -1.0)
            if len(self.known) < KNOWN:
                self.known[word] = got
        return got

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, known = np.zeros((len(texts), self.dimension)), self.known
        for row, text in zip(out, texts):
            mine = [0.0] * self.dimension
            for w, times in Counter(_words(fold_query(text))).items():
                at, sign = known.get(w) or self._place(w)
                mine[at] += sign * times
            row[:] = mine
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0).tolist()


def _words(folded: str) -> list[str]:
    """The words of a folded text; ASCII is cut without the regular expression."""
    return folded.encode().translate(_NOT_WORD).decode().split() if folded.isascii() else regex.findall(WORD, folded)


def vectors_of(texts: pa.Array, provider: Provider) -> pa.Array:
    """list<float> of an array of texts, taken in ``slices``, so that beside the array and its vectors only one slice is held."""
    out = []
    for part in slices(texts):
        given = part.drop_null().to_pylist()
        vectors = provider.embed(given) if given else []
        if len(vectors) != len(given) or any(v is None or len(v) != provider.dimension for v in vectors):
            raise CouldNotEmbed(f"the model gave no vector of dimension {provider.dimension} for some text")
        flat = np.asarray(vectors, np.float32).reshape(-1)
        ends = np.cumsum(part.is_valid().to_numpy(zero_copy_only=False), dtype=np.int32) * provider.dimension
        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.float32())))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))


def embed_column(text: Column, provider: Provider) -> Column:
    """array<float> of the model's dimension; null texts have an empty vector."""

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider.load()
        for texts in batches:
            yield vectors_of(texts, provider)

    return run(text)


def embed_pieces(pieces: DataFrame, provider: Provider) -> DataFrame:
    """piece_id, parent_id, embedding; images aren't embedded and have no row."""
    texts = pieces.filter((F.col("content_type") == TEXT) & F.col("text_content").isNotNull())
    return texts.select(F.col("id").alias("piece_id"), "parent_id", embed_column(F.col("text_content"), provider).alias("embedding"))
