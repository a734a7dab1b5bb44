"""Perplexity under a Brown class-based bigram model of the corpus itself.

P(w | v) = P(class of w | class of v) * P(w | class of w). Unigrams are counted over all documents; all words seen ``MIN_COUNT`` times or
more are the clustered vocabulary, which grows with the corpus. Their classes come from
exchange clustering on the bigram counts of all documents: in each round every word's best class is found in parallel on
the executors, where the counts lie, against one small class-by-class table, half of the words move, or fewer where that doesn't raise the
likelihood, until a round gains next to nothing (``TOLERANCE``). Words seen ``FREQUENT`` times or more, which are few, are exchanged first; the
others join the classes these made, and then all are exchanged together until nothing is gained. Words seen less often have classes by length, in which each has its own count; one count more of each such class is set
aside for all words never seen. Transitions are smoothed after Witten and Bell.

Workers know words by keys of 61 bits, 20 bytes a clustered word; two words with the same key would count as one (of ten million seen words, a
chance of one in 45,000 that any two have).

Defined results: null, empty and blank texts have no perplexity (null) and 0 tokens; an empty table gives an empty result; repeated rows count as often
as they occur, and get the same score each; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from copy import copy
from itertools import count
from string import punctuation
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, read_table

#: Of a clustered word. Words below it were seen once, so that what they are counted as loses nothing.
MIN_COUNT = 2
CLASSES = 64
#: Clustering ends when a round over all words gains less than this share of the likelihood.
TOLERANCE = 1e-4
#: The same for the frequent words by themselves, which are exchanged again with all others.
FIRST_TOLERANCE = 1e-3
_WORD = re.compile(r"\w+")
#: Words seen at least so often are clustered first, by themselves.
FREQUENT = 50
#: Words seen at least so often are spread over many tasks by what stands beside them.
HOT = 1_000_000
#: Tokens of the corpus for each bucket of bigrams, entries of a row of them, and words whose moves are weighed at once.
BUCKET, PACK, AT_ONCE = 1_500_000, 250_000, 4096
#: Files of packed bigrams that a task reads at most; every task costs some hundredths of a second besides.
AT_MOST = 8
#: Classes of rare words by length, and one for those with digits; then the boundary of documents.
RARE = 6
_LENGTHS = (3, 5, 7, 10)
#: What isn't of a word, of the first 256 characters, as blanks.
_BLANKED = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return plain.translate(_BLANKED).decode("latin-1").split()  # the same words, sooner


def rare_class(word: str) -> int:
    if not word.isalpha():
        return RARE - 1
    for k, most in enumerate(_LENGTHS):
        if len(word) <= most:
            return k
    return RARE - 2


def keys_of(words: list[str]) -> np.ndarray:
    """61 bits of a hash of each word and, in the last three, its class by length."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    lengths = np.searchsorted(_LENGTHS, np.fromiter(map(len, words), np.int64, len(words)))
    rare = np.where(np.fromiter(map(str.isalpha, words), bool, len(words)), lengths, RARE - 1)  # rare_class of each
    return (h & ~np.uint64(7) | rare.astype(np.uint64)).view(np.int64)


def _joined_bytes(values: np.ndarray, ends) -> pa.Array:
    """Numbers of all rows in a row, as a binary value a row: the JVM copies those at once, and arrays number by number."""
    ends = np.asarray(ends, np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all rows in a row, how many each row has) of such a column."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]
    return np.frombuffer(data, kind), np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


def _hashes(batches):
    """Texts as the keys of their words."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            words: list[str] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                words += words_of(t)
                ends.append(len(words))
            known = defaultdict(count().__next__)
            at_known = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            keys = keys_of(list(known))[at_known]
            yield pa.RecordBatch.from_arrays([b.column(0), _joined_bytes(keys, ends)], ["doc_id", "keys"])


def _totals(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, sum of each one's n)."""
    if n is None:
        return np.unique(code, return_counts=True)
    bits = int(n.max(initial=0)).bit_length()
    if len(code) and code.min() >= 0 and int(code.max()).bit_length() + bits < 64:
        both = np.sort(code << bits | n)  # some times faster than an order of them
        code, n = both >> bits, both & (1 << bits) - 1
    else:
        order = np.argsort(code)
        code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _count_keys(batches):
    held, size = [], 0

    def flush():
        whole = list(map(np.concatenate, zip(*held)))
        held.clear()  # so that a task holds it once
        key, n = _totals(*whole)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    for b in batches:
        held.append(np.unique(_numbers(b.column("keys"), np.int64)[0], return_counts=True))
        size += len(held[-1][0])
        if size > 3_000_000:
            yield flush()
            size = 0
    if held:
        yield flush()


class Vocabulary:
    """Symbols: clustered words first, then the classes of rare words, once for each count that rare words have and once for words never seen, then the boundary."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None):
        """words: keys of the clustered words; counts: those that rare words have; rare: keys of the rare words and each one's place in counts, or
        None where texts are known to hold no word that wasn't seen and all rare words have one count."""
        self.words, self.counts = words, counts
        self.order = np.argsort(words).astype(np.int32)
        self.sorted = words[self.order]
        if rare is None:
            self.rare = None
        else:
            order = np.argsort(rare[0])
            self.rare = rare[0][order], rare[1][order].astype(np.int32)
        self.boundary = len(words) + RARE * (len(counts) + 1)
        self.size = self.boundary + 1

    def of_keys(self, key: np.ndarray) -> np.ndarray:
        level = np.zeros(len(key), np.int64)
        if self.rare is not None:
            level[:] = len(self.counts)
            if len(self.rare[0]):
                at = np.minimum(np.searchsorted(self.rare[0], key), len(self.rare[0]) - 1)
                level = np.where(self.rare[0][at] == key, self.rare[1][at], level)
        out = len(self.words) + level * RARE + (key & 7)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.sorted, key), len(self.words) - 1)
            out = np.where(self.sorted[at] == key, self.order[at], out)
        return out

    def between(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols of all texts, whose words' keys come in a row, each text with words followed by a boundary."""
        kinds, back = np.unique(keys, return_inverse=True)
        out = np.full(len(keys) + np.count_nonzero(size), self.boundary, np.int64)
        out[np.arange(len(keys)) + np.repeat(np.cumsum(size > 0) - 1, size)] = self.of_keys(kinds)[back]
        return out

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts, each between boundaries; how many words each text has)."""
        found = [words_of(t) for t in texts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.r_[self.boundary, self.between(keys_of([w for f in found for w in f]), size)], size

    def joined(self, s: np.ndarray) -> np.ndarray:
        """Symbols of which rare words have one a class; the boundary follows those."""
        n = len(self.words)
        return np.where(s < n, s, np.where(s == self.boundary, n + RARE, n + (s - n) % RARE))


def _encode(vocabulary):
    """Keys as symbols, each text with a boundary at its end; a text without words has none."""

    def run(batches):
        v: Vocabulary = vocabulary.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                keys, size = _numbers(b.column(1), np.int64)
                s = v.between(keys, size)
                ends = np.concatenate([[0], np.cumsum(size + (size > 0))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), _joined_bytes(s.astype(np.int32), ends)], ["doc_id", "n", "s"])

    return run


KEYS = "doc_id long, keys binary"
SYMBOLS = "doc_id long, n long, s binary"


def _values(batch: pa.RecordBatch, boundary: int) -> np.ndarray:
    """The symbols of a batch's texts in a row, after a boundary."""
    return np.concatenate([[boundary], _numbers(batch.column(batch.schema.get_field_index("s")), np.int32)[0]]).astype(np.int64)


_CHUNK = "bucket int, w binary, other binary, n binary, big binary"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _chunks(w: np.ndarray, other: np.ndarray, n: np.ndarray, buckets: int, hot: int):
    """Bigrams (word, neighbour * 2 + 1 if it follows, count) as one row of arrays a bucket; words below ``hot`` are spread by their neighbours."""
    spread = w.astype(np.uint64) + np.where(w < hot, (other >> 1).astype(np.uint64) << np.uint64(20), 0)
    bucket = ((spread * _MULT >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    w, other, n = (x[order] for x in (w.astype(np.int32), other.astype(np.uint32), n.astype(np.int64)))
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts, cuts[1:]):
        cols = [w[lo:hi], other[lo:hi], *_narrow(n[lo:hi])]
        yield pa.RecordBatch.from_arrays([pa.array([bucket[lo]], pa.int32()), *map(_cell, cols)], ["bucket", "w", "other", "n", "big"])


def _cell(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def _narrow(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts in a byte each, 255 for those that don't fit; these in order)."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.int64)


def _wide(n: np.ndarray, big: np.ndarray, kind=np.int64) -> np.ndarray:
    out = n.astype(kind)
    if len(big):
        out[n == 255] = big
    return out


def _sides(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: int):
    """Bigrams by their first words and then, where that is clustered, by their second ones."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    yield a, b.astype(np.uint32) * 2 + 1, n
    back = b < words
    yield b[back], a[back].astype(np.uint32) * 2, n[back]


def _count_bigrams(vocabulary, buckets: int, hot: int):
    def run(batches):
        v: Vocabulary = vocabulary.value
        held, n = [], 0

        def flush():
            whole = np.concatenate(held)
            held.clear()
            code, count = np.unique(whole, return_counts=True)
            del whole
            for side in _sides(code >> 32, code & 0xFFFFFFFF, count, len(v.words)):
                yield from _chunks(*side, buckets, hot)

        for b in batches:
            s = v.joined(_values(b, v.boundary))
            if len(s) > 1:
                held.append(s[:-1] << 32 | s[1:])
                n += len(s)
            if n > 4_000_000:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return run


def _given_bigrams(words: int, buckets: int, hot: int):
    def run(batches):
        for x in batches:
            for side in _sides(*(x.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n")), words):
                yield from _chunks(*side, buckets, hot)

    return run


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, up to what no clustering changes: sum n log n less both margins."""
    return float(_h(table).sum() - _h(table.sum(axis=1)).sum() - _h(table.sum(axis=0)).sum())


def move_gains(table: np.ndarray, mine: int, left: np.ndarray, right: np.ndarray, own: float, targets: int) -> np.ndarray:
    """Change of the likelihood when a word leaves its class for each of the first classes.

    left[c], right[c]: how often members of class c stand before and after the word (the word itself not counted); own: the word after itself.
    """
    return all_gains(table, np.array([mine]), np.asarray(left, float)[None], np.asarray(right, float)[None], np.array([own], float), targets)[0]


def _filled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what isn't zero."""
    at = np.flatnonzero(x.ravel() != 0)
    row = at // x.shape[1]
    return row, at - row * x.shape[1]


def all_gains(table: np.ndarray, mine: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, targets: int) -> np.ndarray:
    """The same for many words, a row each. Only cells where a word has counts change, and words of like counts share what they change."""
    t, n = table.astype(float), len(mine)
    every = np.arange(n)
    row, col = t.sum(axis=1), t.sum(axis=0)
    wl, wr = left.sum(axis=1) + own, right.sum(axis=1) + own
    gain, stay, buffer = np.zeros((n, targets)), np.zeros(n), np.empty((n, targets))
    flat = gain.ravel()
    # cells of the row, then of the column, that the word's counts are added to
    for side, back, cells in ((right, left, t.T), (left, right, t)):
        w, c = _filled(side)
        value = side[w, c]
        pairs, which = np.unique((c.astype(np.int64) << 48) + value.astype(np.int64), return_inverse=True)
        cell, more = cells[pairs >> 48][:, :targets], (pairs & (1 << 48) - 1)[:, None].astype(float)
        added = _h(cell + more) - _h(cell)
        # cells of the old class lose the word first
        mark = c == mine[w]
        if mark.any():
            x, same, less = w[mark], which[mark], back[w[mark], :targets]
            which[mark] = len(added) + np.arange(len(x))
            added = np.concatenate([added, added[same]])
            i, j = _filled(less)  # the others lose nothing
            old = cells[mine[x[i]], j] - less[i, j]
            added[which[mark][i], j] = _h(old + value[mark][i]) - _h(old)
        # the first cell of every word, then the second of those that have one; words with the most come first
        size = np.bincount(w, minlength=n)
        most, place = np.argsort(-size, kind="stable"), np.empty(n, np.int64)
        place[most] = every
        first, total = (np.cumsum(size) - size)[most], np.zeros((n, targets))
        for r, m in enumerate((n - np.cumsum(np.bincount(size)))[:-1]):
            total[:m] += np.take(added, which[first[:m] + r], axis=0, out=buffer[:m], mode="clip")
        gain += total[place]
        inside = c < targets
        flat[w[inside] * targets + c[inside]] -= added[which[inside], c[inside]]  # where row and column cross
        # what taking the word out costs
        cell = cells[c, mine[w]]
        stay += np.bincount(w, np.where(mark, 0.0, _h(cell) - _h(cell - value)), n)
    corner = left[:, :targets] + right[:, :targets] + own[:, None]
    w, c = _filled(corner)
    d = np.diag(t)[c]
    flat[w * targets + c] += _h(d + corner[w, c]) - _h(d)
    for margin, more in ((row, wr), (col, wl)):
        values, which = np.unique(more, return_inverse=True)
        gain -= (_h(margin[:targets] + values[:, None]) - _h(margin[:targets]))[which]
    corner = t[mine, mine]
    stay += _h(corner) - _h(corner - left[every, mine] - right[every, mine] - own)
    stay -= _h(row[mine]) - _h(row[mine] - wr) + _h(col[mine]) - _h(col[mine] - wl)
    gain -= stay[:, None]
    home = mine < targets
    gain[every[home], mine[home]] = 0.0
    return gain


#: Bigrams by word: each word once, then for what follows it and for what it follows how many there are, which and how often.
_PACKED = ["w", *[f"{side}_{what}" for side in ("after", "before") for what in ("size", "other", "n", "big")]]
_AFTER = _PACKED[:5]


def _pack(batches):
    """The rows of a bucket, which come sorted by bucket, as bigrams by word in order, each once, in rows of some ``PACK`` entries. A word is in one row of a bucket."""
    held: list[tuple[np.ndarray, ...]] = []
    now = None

    def flush():
        w, other, n = map(np.concatenate, zip(*held))
        held.clear()
        bits = max(1, int(other.max(initial=0)).bit_length())  # its lowest bit is a side
        code, n = _totals(w.astype(np.int64) << bits | other, n)
        w, other, after = (code >> bits).astype(np.int32), ((code & (1 << bits) - 1) >> 1).astype(np.uint32), (code & 1).astype(bool)
        at = 0
        while at < len(w):
            end = int(np.searchsorted(w, w[min(at + PACK, len(w)) - 1], "right"))
            names, place = np.unique(w[at:end], return_inverse=True)
            cols = [names]
            for side in (after[at:end], ~after[at:end]):
                cols += [np.bincount(place[side], minlength=len(names)).astype(np.int32), other[at:end][side], *_narrow(n[at:end][side])]
            yield pa.RecordBatch.from_arrays(list(map(_cell, cols)), _PACKED)
            at = end

    for b in batches:
        for bucket, *cols in zip(*(b.column(c).to_pylist() for c in ("bucket", "w", "other", "n", "big"))):
            if bucket != now and held:
                yield from flush()
            now = bucket
            w, other, n, big = (np.frombuffer(x, t) for x, t in zip(cols, (np.int32, np.uint32, np.uint8, np.int64)))
            held.append((w, other, _wide(n, big)))
    if held:
        yield from flush()


def _stored(files: list[str], columns: list[str]):
    """The rows of such files. Workers read them themselves: through the JVM every value is copied some times on its way, in every round."""
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            for group in range(file.num_row_groups):
                yield from file.read_row_group(group, columns, use_threads=False).to_batches()


def _unpacked(batches):
    """(words, for each side (how many entries each word has, neighbours, counts in bytes, those that don't fit)); the second side is there if it was read."""
    for b in batches:
        for row in zip(*b.columns):
            w, *cols = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int32, *(np.int32, np.uint32, np.uint8, np.int64) * 2)))
            yield w, *(tuple(cols[at : at + 4]) for at in range(0, len(cols), 4))


def _class_table(sent, k: int):
    """Sums of counts by class of both words, one row of k * k a partition."""

    def run(batches):
        classes = sent.value
        total = np.zeros(k * k)
        for w, (size, other, n, big) in _unpacked(batches):
            code = np.repeat(classes[w] * classes.dtype.type(k), size)  # k * k fits
            code += classes[other]
            total += np.bincount(code, minlength=k * k)
            more = np.flatnonzero(n > 1)
            total += np.bincount(code[more], _wide(n[more], big, float) - 1, k * k)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["t"])

    return run


def _vectors(names, before, after, classes, k):
    """Of each named word (counts by class before it, after it, times after itself). before, after: (entries of each name, neighbours, counts)."""
    out = []
    for size, other, n in (before, after):
        code = np.repeat(np.arange(0, len(names) * k, k), size)
        code += classes[other]
        sums = np.bincount(code, n, len(names) * k)
        own = np.flatnonzero(other == np.repeat(names, size))  # at most one of each name
        sums[code[own]] -= n[own]
        out.append(sums.reshape(-1, k))
    times = np.zeros(len(names))
    times[code[own] // k] = n[own]
    return *out, times


_MOVES = "w int, c int, gain double, parts array<double>"


def _moves(names, best, gain) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(best.astype(np.int32)), pa.array(gain), pa.nulls(len(names), pa.list_(pa.float64()))], ["w", "c", "gain", "parts"])


def _choose(table, names, mine, vectors, forced: bool):
    gain = all_gains(table, mine, *vectors, CLASSES)
    best = gain.argmax(axis=1)
    gain = gain[np.arange(len(names)), best]
    to = np.flatnonzero((best != mine) & ((gain > 1e-6) | forced))  # less may be rounding
    return names[to], best[to], gain[to]


def _best_classes(sent, table: np.ndarray, k: int, first: int, words: int, hot: int, forced: bool, only=None):
    """(word, class, gain) for each word from ``first`` on (of those marked in ``only``) that would rather be in another class; of the spread words their
    counts in this part."""

    def run(batches):
        classes = sent.value
        marked = only and only.value
        wide = classes.astype(np.int64)
        for w, *sides in _unpacked(batches):
            wanted = (w >= first) & (w < words)
            if marked is not None:
                wanted &= marked[w]
            if not wanted.any():
                continue
            w, cut = w[wanted], []
            for size, other, n, big in sides:
                entries = np.repeat(wanted, size)
                size = size[wanted]
                cut.append((size, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), other[entries], _wide(n, big, float)[entries]))
            of = lambda a, b: [(size[a:b], other[at[a] : at[b]], n[at[a] : at[b]]) for size, at, other, n in reversed(cut)]
            mid = int(np.searchsorted(w, hot))
            if mid:
                before, behind, own = _vectors(w[:mid], *of(0, mid), wide, k)
                parts = np.concatenate([before, behind, own[:, None]], axis=1)
                none = pa.nulls(mid, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(w[:mid]), none.cast(pa.int32()), none, pa.array(parts.tolist(), pa.list_(pa.float64()))], ["w", "c", "gain", "parts"])
            for a in range(mid, len(w), AT_ONCE):
                names = w[a : a + AT_ONCE]
                vectors = _vectors(names, *of(a, a + len(names)), wide, k)
                yield _moves(*_choose(table, names, wide[names], vectors, forced))

    return run


class _Exchange:
    """The state of the clustering, and its jobs over the packed bigrams."""

    def __init__(self, spark: SparkSession, both: DataFrame, classes: np.ndarray, words: int, hot: int):
        self.spark, self.both, self.words, self.hot, self.k = spark, both, words, hot, CLASSES + RARE + 1
        self.classes, self.score = classes, []
        files = [quote(x, punctuation) for x in both.inputFiles()]  # Spark leaves letters beyond ASCII as they are
        self.tasks = min(len(files), max(2 * spark.sparkContext.defaultParallelism, -(-len(files) // AT_MOST)))
        try:
            fs.FileSystem.from_uri(files[0])
        except (IndexError, OSError, pa.ArrowException):  # no rows, or files that only Spark can read
            self.tasks = 0
        self.files = spark.sparkContext.broadcast(files)
        self.sent = spark.sparkContext.broadcast(classes)
        self.table = self.table_of(self.sent)
        self.score = [likelihood(self.table)]

    def over(self, columns: list[str], run, schema: str) -> DataFrame:
        """What ``run`` makes of these columns of the packed bigrams."""
        if not self.tasks:
            return self.both.select(*columns).mapInArrow(run, schema)
        files, tasks = self.files, self.tasks
        return self.spark.range(0, tasks, 1, tasks).mapInArrow(lambda ids: run(b for x in ids for i in x.column(0).to_pylist() for b in _stored(files.value[i::tasks], columns)), schema)

    def table_of(self, sent) -> np.ndarray:
        rows = self.over(_AFTER, _class_table(sent, self.k), "t array<double>").collect()  # k * k numbers a partition
        return np.sum([np.array(r[0]) for r in rows], axis=0).reshape(self.k, self.k) if rows else np.zeros((self.k, self.k))

    def moves(self, first: int, last: int, forced: bool = False, only: np.ndarray | None = None) -> pd.DataFrame:
        marked = None if only is None else self.spark.sparkContext.broadcast(only)
        found = self.over(_PACKED, _best_classes(self.sent, self.table, self.k, first, last, self.hot, forced, marked), _MOVES).toArrow()
        if marked is not None:
            marked.destroy()
        part = found.filter(pc.is_valid(found.column("parts")))
        found = found.filter(pc.is_null(found.column("parts"))).select(["w", "c", "gain"]).to_pandas()
        if part.num_rows:
            names, at = np.unique(part.column("w").to_numpy(), return_inverse=True)
            total = np.zeros((len(names), 2 * self.k + 1))
            np.add.at(total, at, np.array(part.column("parts").to_pylist()))
            vectors = total[:, : self.k], total[:, self.k : -1], total[:, -1]
            mine = _choose(self.table, names, self.classes[names].astype(np.int64), vectors, forced)
            found = pd.concat([pd.DataFrame(dict(zip(("w", "c", "gain"), mine))), found])
        return found

    def put(self, chosen: pd.DataFrame, forced: bool = False) -> float:
        """Moves the words, and takes that back where it doesn't raise the likelihood; what it gained."""
        new = self.classes.copy()
        new[chosen.w.to_numpy()] = chosen.c.to_numpy()
        sent = self.spark.sparkContext.broadcast(new)
        table = self.table_of(sent)
        now = likelihood(table)
        if now <= self.score[-1] and not forced:
            sent.destroy()
            return 0.0
        self.sent.destroy()
        gained = now - self.score[-1]
        self.classes, self.table, self.sent = new, table, sent
        self.score = [now] if forced else [*self.score, now]
        return gained

    def settle(self, last: int, tolerance: float = TOLERANCE) -> None:
        """Exchanges the words before ``last`` until nothing is gained any more.

        A round looks at all words; those that would move are looked at again until they gain nothing, and then all are once more.
        """
        share, r, only = 2, 0, None
        while last:
            moves = self.moves(0, last, only=only)
            gained = 0.0
            while len(moves) and not gained:
                # at last the best move alone, which can only fail by rounding
                alone = share >= len(moves)
                chosen = moves.nlargest(1, "gain") if alone else moves[(moves.w.astype("int64") * 2654435761 // 65536 + r) % share == 0]
                gained = self.put(chosen)
                if not gained:
                    if alone:
                        break
                    share *= 2  # too many moved at once against the same table
            # what half of the words would have gained counts, however few were let
            if gained * share / 2 < tolerance * abs(self.score[-1]):
                if only is None:
                    break
                only = None
            else:
                only = np.zeros(len(self.classes), bool)
                only[moves.w.to_numpy()] = True
            share = max(2, share // 2)
            r += 1


def exchange(spark: SparkSession, both: DataFrame, rare: np.ndarray, hot: int = 0, frequent: int | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each symbol, class-by-class counts, likelihood after each round that raised it).

    rare: the class by length of each word, words in order of their counts. The first ``frequent`` words are exchanged while the others are in
    those classes; then each of the others joins the class that suits it best, and all are exchanged.
    """
    words = len(rare)
    frequent = words if frequent is None else frequent
    classes = np.concatenate([np.arange(frequent) % CLASSES, CLASSES + rare[frequent:], CLASSES + np.arange(RARE + 1)]).astype(np.int16)
    e = _Exchange(spark, both, classes, words, hot)
    e.settle(frequent, TOLERANCE if frequent == words else FIRST_TOLERANCE)
    if frequent < words:
        e.put(e.moves(frequent, words, True), True)
        e.settle(words)
    return e.classes, e.table, e.score


def cluster(scratch: Scratch, bigrams: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The same for a table of bigrams (a, b, n) of symbols, each once."""
    chunks = bigrams.mapInArrow(_given_bigrams(words, 4, 0), _CHUNK)
    return exchange(scratch.spark, scratch.table(packed(chunks, 4), "both"), np.zeros(words, np.int64))


def packed(chunks: DataFrame, buckets: int) -> DataFrame:
    return chunks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_pack, ", ".join(f"{c} binary" for c in _PACKED))


class Model:
    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, table: np.ndarray, counts: np.ndarray):
        """classes: of the clustered words, the rare classes and the boundary; counts: of the clustered words."""
        n = len(counts)
        self.vocabulary = vocabulary
        self.classes = np.concatenate([classes[:n], np.tile(classes[n : n + RARE], len(vocabulary.counts) + 1), classes[n + RARE :]])
        k = len(table)
        after = table.sum(axis=1, keepdims=True)
        different = (table > 0).sum(axis=1, keepdims=True)
        share = (table.sum(axis=0) + 1) / (table.sum() + k)
        weight = np.where(after > 0, different / np.maximum(after + different, 1), 1.0)
        self.transition = np.log((1 - weight) * table / np.maximum(after, 1) + weight * share[None, :])
        emission = np.zeros(vocabulary.size)
        if n:
            emission[:n] = np.log(counts / np.bincount(classes[:n], counts, k)[classes[:n]])
        of_class = table.sum(axis=0)[CLASSES : CLASSES + RARE]  # every word follows something
        emission[n : vocabulary.boundary] = (np.log(np.append(vocabulary.counts, 1.0))[:, None] - np.log(of_class + 1)[None, :]).ravel()
        self.emission = emission

    def log_probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log-probability of each text with its end, number of words)."""
        s, size = self.vocabulary.symbols(texts)
        return self.of_symbols(s, size), size

    def of_symbols(self, s: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same for texts as symbols in a row, after a boundary; size: words of each text."""
        if len(s) < 2:
            return np.zeros(len(size))
        c = self.classes[s]
        has = np.flatnonzero(size)
        owner = np.repeat(has, size[has] + 1)  # text by text, so that a sum doesn't depend on what stands before
        return np.bincount(owner, self.transition[c[:-1], c[1:]] + self.emission[s[1:]], len(size))


def fit(spark: SparkSession, docs: DataFrame, min_share: float | None = None) -> Model:
    """min_share: of all tokens, for a clustered word, in place of MIN_COUNT. The model can tell words never seen."""
    return _fit(spark, docs, min_share, True)[0]


def _fit(spark: SparkSession, docs: DataFrame, min_share: float | None = None, unseen: bool = False) -> tuple[Model, DataFrame]:
    """(model, the documents as symbols): texts are split into words once, and then only the keys of their words are read.

    unseen: whether the model is for other documents too, so that it must have the keys of the rare words.
    """
    scratch = Scratch(spark, "brown")
    hashes = scratch.table(docs.select("doc_id", "text").mapInArrow(_hashes, KEYS), "keys", "zstd")
    keyed = scratch.table(hashes.select("keys").mapInArrow(_count_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "unigrams")
    total = keyed.agg(F.sum("n")).first()[0] or 0
    least = MIN_COUNT if min_share is None else max(1, total * min_share)
    rows = keyed.filter(F.col("n") >= least).toArrow()
    keys, counts = (rows.column(c).to_numpy() for c in ("key", "n"))
    order = np.lexsort([keys, -counts])
    keys, counts = keys[order], counts[order]
    levels, rare = np.ones(1), None
    if unseen or least > 2:
        rows = keyed.filter(F.col("n") < least).toArrow()
        levels, place = np.unique(rows.column("n").to_numpy(), return_inverse=True)
        rare = rows.column("key").to_numpy(), place
    vocabulary = Vocabulary(keys, levels, rare)
    sent = spark.sparkContext.broadcast(vocabulary)
    symbols = scratch.table(hashes.mapInArrow(_encode(sent), SYMBOLS), "symbols", "zstd")
    scratch.drop("keys")
    buckets = max(1, -(-total // BUCKET))
    hot, frequent = (int(np.searchsorted(-counts, -x, "right")) for x in (HOT, FREQUENT))
    chunks = symbols.select("s").mapInArrow(_count_bigrams(sent, buckets, hot), _CHUNK)
    both = scratch.table(packed(chunks, buckets), "both", "none")
    classes, table, _ = exchange(spark, both, keys & 7, hot, frequent)
    for name in ("unigrams", "both"):
        scratch.drop(name)
    return Model(vocabulary, classes, table, counts.astype(float)), symbols


def perplexity(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document: doc_id, n_tokens, log_prob, perplexity."""
    if model is None:
        model, symbols = _fit(spark, docs)
    else:
        symbols = docs.select("doc_id", "text").mapInArrow(_hashes, KEYS).mapInArrow(_encode(spark.sparkContext.broadcast(model.vocabulary)), SYMBOLS)
    boundary = model.vocabulary.boundary
    model = copy(model)
    model.vocabulary = None  # not needed for texts that are symbols
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            n = b.column(1).to_numpy()
            p = m.of_symbols(_values(b, boundary), n)
            with np.errstate(over="ignore"):
                per = np.exp(-p / (n + 1))
            none = n == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(p, pa.float64(), mask=none), pa.array(per, pa.float64(), mask=none)], ["doc_id", "n_tokens", "log_prob", "perplexity"])

    return symbols.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, perplexity double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity(spark, read_table(spark, sf_dir, "documents"))
