"""Language identification by prediction by partial matching.

One context tree of bytes per language, of orders 0 to ``ORDER`` within a word (a word's first context is the blank before it), with the
escape probabilities of method C. The trees are trained on a bounded sample of labelled documents (``TRAIN_DOCS`` a language, those
with the least hash) and frozen; a document's language is the one whose tree gives its words the shortest exact code.

The statistics being frozen, a symbol's code length depends on its word alone, so each batch codes every distinct word once, for all
languages together, by lookups in sorted tables.

Defined results: null, empty and blank texts have no language (null); rows with a null label train nothing but are identified; without any
labelled row every language is null; ties go to the first language by name; repeated rows get the same answer each; further columns are
ignored; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table, row_key

ORDER = 4
TRAIN_DOCS = 400


def _positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, each between blanks; place of each byte in its word; word of each byte)."""
    raw = [b" " + w.encode("utf-8", "replace") + b" " for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    return data, np.arange(len(data)) - np.repeat(start, size), np.repeat(np.arange(len(raw)), size)


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """The order bytes before each byte and the byte itself as one number; what reaches before a word must not be used."""
    key = data.copy()
    for k in range(1, order + 1):
        key[k:] |= data[:-k] << np.uint64(8 * k)
    return key


class Trees:
    """Frozen context trees of several languages as sorted tables of code lengths in bits, one column a language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        n = len(self.languages)
        grams: list[dict] = []
        for k in range(ORDER + 1):
            grams.append({})
        for col, lang in enumerate(self.languages):
            count: dict[str, int] = {}
            for t in texts[lang]:
                for w in t.lower().split():
                    count[w] = count.get(w, 0) + 1
            if not count:
                continue
            data, place, word = _positions(list(count))
            times = np.fromiter(count.values(), np.int64, len(count))[word]
            for k in range(ORDER + 1):
                ok = place >= max(k, 1)
                key, back = np.unique(_keys(data, k)[ok], return_inverse=True)
                grams[k][col] = (key, np.bincount(back, times[ok]))
        self.gram: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.context: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([g for g, _ in grams[k].values()])) if grams[k] else np.empty(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8)) if k else np.zeros(1, np.uint64)
            if k:
                mask = np.uint64((1 << (8 * k)) - 1)
                below = np.searchsorted(self.gram[k - 1], keys & mask)
                lower = self.cost[k - 1][below]
            else:
                lower = np.full((len(keys), n), np.log2(257.0))
            cost = lower.copy()
            escape = np.zeros((len(contexts), n))
            for col, (g, c) in grams[k].items():
                at = np.searchsorted(contexts, g >> np.uint64(8)) if k else np.zeros(len(g), np.int64)
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                with np.errstate(divide="ignore"):
                    escape[:, col] = np.where(total > 0, np.log2(total + kinds) - np.log2(np.maximum(kinds, 1)), 0.0)
                where = np.searchsorted(contexts, keys >> np.uint64(8)) if k else np.zeros(len(keys), np.int64)
                cost[:, col] = lower[:, col] + escape[where, col]
                here = np.searchsorted(keys, g)
                cost[here, col] = np.log2(total[at] + kinds[at]) - np.log2(c)
            self.gram.append(keys)
            self.cost.append(cost)
            self.context.append(contexts)
            self.escape.append(escape)

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Code length in bits of each word (and the blank after it) in each language."""
        data, place, word = _positions(words)
        total = np.zeros((len(words), len(self.languages)))
        todo = np.flatnonzero(place >= 1)
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            deep = place[todo] >= k
            use, shallow = todo[deep], todo[~deep]
            key = _keys(data, k)[use]
            at = np.searchsorted(self.gram[k], key)
            at[at == len(self.gram[k])] = 0
            hit = self.gram[k][at] == key if len(self.gram[k]) else np.zeros(len(key), bool)
            self._add(total, word[use[hit]], self.cost[k], at[hit])
            miss, gone = use[~hit], key[~hit]
            if k:
                c = gone >> np.uint64(8)
                at = np.searchsorted(self.context[k], c)
                at[at == len(self.context[k])] = 0
                known = self.context[k][at] == c if len(self.context[k]) else np.zeros(len(c), bool)
                self._add(total, word[miss[known]], self.escape[k], at[known])
                todo = np.concatenate([miss, shallow])
            else:
                self._add(total, word[miss], self.escape[0] + np.log2(257.0), np.zeros(len(miss), np.int64))
        return total

    def _add(self, total: np.ndarray, word: np.ndarray, table: np.ndarray, at: np.ndarray) -> None:
        if len(word):
            for col in range(total.shape[1]):
                total[:, col] += np.bincount(word, table[at, col], len(total))

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each text in each language; nan for a text without words."""
        known: dict[str, int] = {}
        number = known.setdefault
        ids: list[int] = []
        ends = []
        for t in texts:
            if t:
                ids += [number(w, len(known)) for w in t.lower().split()]
            ends.append(len(ids))
        out = np.full((len(texts), len(self.languages)), np.nan)
        if ids:
            bits = self.word_bits(list(known))[np.array(ids)]
            size = np.diff(np.array([0, *ends]))
            owner = np.repeat(np.arange(len(texts)), size)
            for col in range(bits.shape[1]):  # text by text, so that a sum doesn't depend on what stands before
                out[size > 0, col] = np.bincount(owner, bits[:, col], len(texts))[size > 0]
        return out


def training_texts(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, list[str]]:
    """The bounded labelled sample: for each language the documents with the least hash."""
    labelled = docs.filter("lang is not null and text is not null").select("lang", row_key("doc_id", "text").alias("key"), "text")
    order = Window.partitionBy("lang").orderBy("key")
    chosen = labelled.select("lang", "key").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= train_docs).select("lang", "key")
    # rows that repeat are one row of the sample: each task passes on one of them at most
    rows = labelled.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for r in rows.orderBy("key").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def identify(spark: SparkSession, docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Every document: doc_id, language, bits_per_byte in it, runner_up, margin_bits to that one."""
    trees = spark.sparkContext.broadcast(Trees(training_texts(docs, train_docs)))

    def run(batches):
        t = trees.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = b.column(1).to_pylist()
                best, second, bits, margin = [], [], [], []
                for text, row in zip(texts, t.code_lengths(texts)):
                    if not len(row) or np.isnan(row[0]):
                        best.append(None), second.append(None), bits.append(None), margin.append(None)
                        continue
                    order = np.argsort(row, kind="stable")
                    best.append(t.languages[order[0]])
                    bits.append(row[order[0]] / max(1, len(text.encode("utf-8", "replace"))))
                    second.append(t.languages[order[1]] if len(order) > 1 else None)
                    margin.append(row[order[1]] - row[order[0]] if len(order) > 1 else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(best, pa.string()), pa.array(bits, pa.float64()), pa.array(second, pa.string()), pa.array(margin, pa.float64())],
                    ["doc_id", "language", "bits_per_byte", "runner_up", "margin_bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, language string, bits_per_byte double, runner_up string, margin_bits double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read_table(spark, sf_dir, "documents"))
