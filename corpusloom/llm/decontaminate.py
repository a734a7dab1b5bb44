"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words (lower case, word characters only) are indexed once; training tokens are streamed through the automaton, which
knows after every token the longest suffix that occurs in some item. Tokens in a run of ``MIN_SPAN`` that an item has too are removed; those in runs
of ``MIN_PIECE`` are removed as well where such runs cover ``COVERAGE`` of an item's tokens in one document. An item that is shorter than any run is removed
where it makes up a whole line, since anywhere else chance may repeat it.

The automaton grows with the benchmark and not with the corpus. It is sent out in shards of at most ``SHARD_TOKENS`` item tokens;
a task holds one shard at a time, so any benchmark fits. The items that a run occurs in are a stretch of one array, however many they are.

Defined results: a null, empty or blank item matches nothing; items that repeat count once, by their least item_id (null first); a null, empty or blank document has no match
and passes as it is; repeated documents get the same answer each; a run that several items have is put down to all of them; a document of which only matched spans exist is dropped by the
filter; further columns pass through, and ``n_chars``, if there is one, follows the new text. Letters whose lower case is longer count as one letter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, read_table, with_column

MIN_SPAN = 10
MIN_PIECE = 5
COVERAGE = 0.5
SHARD_TOKENS = 200_000
_WORD = re.compile(r"\w+")


def lower(text: str) -> str:
    """In lower case and of the same length: the capital dotted I, the only letter whose lower case is longer, becomes a plain i."""
    return text.replace("\u0130", "i").lower()


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(lower(text)) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; each state knows the items and positions where it ends."""

    def __init__(self, items: list[tuple[str, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.at: list[list[tuple[int, int]]] = [[]]
        self.names = [n for n, _ in items]
        self.sizes = [len(w) for _, w in items]
        for k, (_, words) in enumerate(items):
            last = 0
            for pos, w in enumerate(words):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                self.at[last].append((k, pos))
        self._order()

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        self.at.append([])
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _order(self) -> None:
        """Ends by a walk through the tree of links, so that those of a state are a stretch; and the states of runs of either length."""
        children: list[list[int]] = [[] for _ in self.len]
        for s, p in enumerate(self.link):
            if p >= 0:
                children[p].append(s)
        self.first, self.last = [0] * len(self.len), [0] * len(self.len)
        ends: list[tuple[int, int]] = []
        todo = [0]
        while todo:
            s = todo.pop()
            if s < 0:
                self.last[~s] = len(ends)
                continue
            self.first[s] = len(ends)
            ends += self.at[s]
            todo.append(~s)
            todo += children[s]
        del self.at
        self.item, self.end = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
        self.top = {n: self._tops(n) for n in (MIN_PIECE, MIN_SPAN)}

    def _tops(self, n: int) -> list[int]:
        """For each state with strings of n tokens or more the one that has their last n."""
        out = [0] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if self.len[s] >= n:
                up = self.link[s]
                out[s] = out[up] if self.len[up] >= n else s
        return out

    def ends(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, positions) of every end of the state's strings."""
        at = slice(self.first[state], self.last[state])
        return self.item[at], self.end[at]

    def runs(self, words: list[str], n: int) -> list[tuple[int, int]]:
        """(place, state) of each run of n tokens that an item has; the state's strings end with it."""
        out, top = [], self.top[n]
        v = size = 0
        for i, w in enumerate(words):
            c = self.vocab.get(w)
            if c is None:
                v = size = 0
                continue
            while v and c not in self.next[v]:
                v = self.link[v]
                size = self.len[v]
            to = self.next[v].get(c)
            v, size = (to, size + 1) if to is not None else (0, 0)
            if size >= n:
                out.append((i - n + 1, top[v]))
        return out

    def matches(self, words: list[str], least: int) -> list[tuple[int, int, int]]:
        """(first token, token after the last, state) of each match of at least that length which no longer one continues."""
        out = []
        get, nxt, link, length = self.vocab.get, self.next, self.link, self.len
        v = n = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                if n >= least:
                    out.append((i - n, i, v))
                v = n = 0
                continue
            to = nxt[v].get(c)
            if to is None:
                if n >= least:
                    out.append((i - n, i, v))
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(c)
                if to is None:
                    n = 0
                    continue
                n = length[v]
            v = to
            n += 1
        if n >= least:
            out.append((len(words) - n, len(words), v))
        return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def token_spans(automaton: SuffixAutomaton, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
    """Token spans to remove, and the names of the items they come from."""
    if not automaton.matches(words, MIN_PIECE):
        return [], set()
    spans, names = [], set()
    for at, s in automaton.runs(words, MIN_SPAN):
        spans.append((at, at + MIN_SPAN))
        names.update(np.unique(automaton.ends(s)[0]).tolist())
    pieces = automaton.runs(words, MIN_PIECE)
    states = sorted({s for _, s in pieces})
    items, ends = zip(*map(automaton.ends, states))
    place = np.concatenate(items) << 32 | np.concatenate(ends)
    place = np.unique((place[:, None] - np.arange(MIN_PIECE)).ravel())  # tokens of items
    found, covered = np.unique(place >> 32, return_counts=True)
    covered = found[covered >= COVERAGE * np.array(automaton.sizes)[found]]
    if len(covered):
        names.update(covered.tolist())
        of = {s for s, i in zip(states, items) if np.isin(i, covered).any()}
        spans += [(at, at + MIN_PIECE) for at, s in pieces if s in of]
    return _union(spans), {automaton.names[k] for k in names}


def line_spans(short: dict[tuple[str, ...], str], text: str) -> tuple[list[tuple[int, int]], set[str]]:
    """The same for items shorter than any run, which are looked for as whole lines."""
    spans, names, at = [], set(), 0
    for line in text.split("\n"):
        words = tuple(tokens(line))
        if words in short:
            spans.append((at, at + len(words)))
            names.add(short[words])
        at += len(words)
    return spans, names


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the character spans; what is left on both sides is parted by a space or, where one was cut, a line break."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a].rstrip(" "))
        at = b
    parts.append(text[at:])
    return " ".join(p for p in (x.strip(" ") for x in parts) if p)


def _clean(shards, short, names_of: tuple[str, str, str, str]):
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            if short:
                for i, t in enumerate(texts):
                    if t:
                        spans[i], names[i] = line_spans(short, t)
            words = [tokens(t) for t in texts] if len(shards) > 1 else None
            for shard in shards:
                automaton = shard.value
                for i, t in enumerate(texts):
                    if t:
                        s, n = token_spans(automaton, words[i] if words else tokens(t))
                        spans[i] += s
                        names[i] |= n
                if len(shards) > 1:  # one shard in memory at a time; it is read again from the worker's disk
                    del automaton, shard._value
            clean, chars = [], []
            for t, s in zip(texts, spans):
                if not s:
                    clean.append(t)
                    chars.append([])
                    continue
                at = [(m.start(), m.end()) for m in _WORD.finditer(lower(t))]
                c = [(at[x][0], at[y - 1][1]) for x, y in _union(s)]
                clean.append(remove(t, c))
                chars.append(c)
            flat = pa.array([[{"start": x, "end": y} for x, y in c] for c in chars], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            b = b.append_column(names_of[0], pa.array(clean, pa.string()))
            b = b.append_column(names_of[1], flat)
            b = b.append_column(names_of[2], pa.array([sorted(n) for n in names], pa.list_(pa.string())))
            yield b.append_column(names_of[3], pa.array([not c or bool(_WORD.search(t)) for t, c in zip(clean, chars)], pa.bool_()))

    return run


def _items(benchmark: DataFrame) -> dict[tuple[str, ...], str]:
    """The different items by their words; the benchmark is a small table by its nature and is read row by row."""
    items: dict[tuple[str, ...], str] = {}
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if words := tuple(tokens(r[1])):
            items.setdefault(words, f"item {r[0]}")
    return items


def automata(spark: SparkSession, benchmark: DataFrame, shard_tokens: int = SHARD_TOKENS) -> list:
    """Broadcast automata, each of a bounded number of item tokens."""
    return _automata(spark, _items(benchmark), shard_tokens)


def _automata(spark: SparkSession, items: dict[tuple[str, ...], str], shard_tokens: int = SHARD_TOKENS) -> list:
    shards, now, size = [], [], 0
    for words, name in items.items():
        if len(words) < MIN_PIECE:
            continue
        if now and size + len(words) > shard_tokens:
            shards.append(spark.sparkContext.broadcast(SuffixAutomaton(now)))
            now, size = [], 0
        now.append((name, list(words)))
        size += len(words)
    return [*shards, spark.sparkContext.broadcast(SuffixAutomaton(now))] if now else shards


def _marked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, str, str, str]:
    """The documents with four more columns, whose names follow: new text, removed spans, items, whether they stay."""
    names = tuple(fresh(docs, f"_decon_{c}") for c in ("text", "spans", "items", "stays"))
    extra = zip(names, ("string", "array<struct<start:int,end:int>>", "array<string>", "boolean"))
    items = _items(benchmark)
    short = {w: n for w, n in items.items() if len(w) < MIN_PIECE}
    return docs.mapInArrow(_clean(_automata(spark, items), short, names), with_column(docs.schema, *extra)), *names


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold test items: doc_id, items, spans (characters, end exclusive), removed_share, clean_text."""
    out, text, spans, items, _ = _marked(spark, docs.select("doc_id", "text"), benchmark)
    out = out.filter(F.size(spans) > 0)
    gone = F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.col(items).alias("items"), F.col(spans).alias("spans"), (gone / F.length("text")).alias("removed_share"), F.col(text).alias("clean_text"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the matched spans, with the columns they came with."""
    out, text, spans, _, stays = _marked(spark, docs, benchmark)
    out = out.filter(F.col(stays))
    changed = F.size(spans) > 0
    cols = []
    for f in docs.schema.fields:
        if f.name == "text":
            cols.append(F.col(text).alias("text"))
        elif f.name == "n_chars":
            cols.append(F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col(f.name))
    return out.select(*cols)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with what is left of them; spans of characters as text: 3-60,100-160."""
    out = contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return out.select("doc_id", F.array_join("items", ",").alias("items"), spans.alias("spans"), F.round("removed_share", 6).alias("removed_share"), "clean_text")


_W = r"[\p{L}\p{N}_]"


def _runs_sql(n: int, of: str, key: str) -> str:
    return f"SELECT {key}, p, array_to_string(w[p + 1:p + {n}], ' ') AS g FROM (SELECT *, unnest(range(len(w) - {n - 1})) AS p FROM {of} WHERE len(w) >= {n})"


#: All runs of documents with all runs of items.
OP5_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(lower(text), '{_W}+') AS w FROM documents),
  item AS (SELECT min(item_id) AS item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '{_W}+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0 GROUP BY w),
  d5 AS ({_runs_sql(MIN_PIECE, "d", "r")}), i5 AS ({_runs_sql(MIN_PIECE, "item", "item_id, n")}), d10 AS ({_runs_sql(MIN_SPAN, "d", "r")}), i10 AS ({_runs_sql(MIN_SPAN, "item", "item_id")}),
  h5 AS (SELECT d5.r, d5.p, item_id, n, i5.p AS q FROM d5 JOIN i5 USING (g)), h10 AS (SELECT DISTINCT d10.r, d10.p, item_id FROM d10 JOIN i10 USING (g)),
  covered AS (SELECT r, item_id FROM (SELECT DISTINCT r, item_id, n, q + unnest(range({MIN_PIECE})) AS tok FROM h5) GROUP BY r, item_id, n HAVING count(*) >= {COVERAGE} * n),
  line AS (SELECT r, sum(len(w)) OVER (PARTITION BY r ORDER BY k) - len(w) AS p, w FROM (SELECT r, unnest(range(len(l))) AS k, regexp_extract_all(lower(unnest(l)), '{_W}+') AS w FROM (SELECT r, string_split(text, chr(10)) AS l FROM d))),
  short AS (SELECT r, p, item_id, n FROM line JOIN item USING (w) WHERE n < {MIN_PIECE}),
  gone AS (SELECT r, p + unnest(range({MIN_SPAN})) AS tok FROM h10 UNION SELECT r, p + unnest(range({MIN_PIECE})) FROM h5 JOIN covered USING (r, item_id) UNION SELECT r, p + unnest(range(n)) FROM short),
  names AS (SELECT r, string_agg('item ' || item_id, ',' ORDER BY 'item ' || item_id) AS items FROM (SELECT r, item_id FROM h10 UNION SELECT r, item_id FROM covered UNION SELECT r, item_id FROM short) GROUP BY r),
  part AS (SELECT r, unnest(range(len(l))) AS k, unnest(l) AS x FROM (SELECT r, regexp_extract_all(lower(text), '{_W}+|[^{_W[1:-1]}]+') AS l FROM d WHERE r IN (SELECT r FROM gone))),
  word AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS tok, a, a + length(x) AS b FROM (SELECT *, sum(length(x)) OVER (PARTITION BY r ORDER BY k) - length(x) AS a FROM part) WHERE regexp_matches(x, '{_W}')),
  span AS (SELECT r, min(a) AS a, max(b) AS b FROM (SELECT r, a, b, tok - row_number() OVER (PARTITION BY r ORDER BY tok) AS island FROM gone JOIN word USING (r, tok)) GROUP BY r, island),
  kept AS (SELECT r, a, trim(substr(text, CAST(before AS BIGINT) + 1, CAST(a - before AS BIGINT)), ' ') AS x FROM (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM span) JOIN d USING (r)
    UNION ALL SELECT r, 1e18, trim(substr(text, CAST(b AS BIGINT) + 1), ' ') FROM (SELECT r, max(b) AS b FROM span GROUP BY r) JOIN d USING (r)),
  clean AS (SELECT r, coalesce(string_agg(x, ' ' ORDER BY a) FILTER (x <> ''), '') AS clean_text FROM kept GROUP BY r),
  shown AS (SELECT r, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS spans, sum(b - a) AS n FROM span GROUP BY r)
  SELECT doc_id, items, spans, round(n / length(text), 6) AS removed_share, clean_text FROM shown JOIN d USING (r) JOIN names USING (r) JOIN clean USING (r)"""
