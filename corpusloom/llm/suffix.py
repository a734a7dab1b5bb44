"""Passages that repeat, found with suffix arrays by induced sorting.

A passage is ``MIN_TOKENS`` words (lower case) or more that occur in the same order somewhere else. Every window of that many words is routed by the
least hash among its ``GRAM``-word grams, a function of its own words, so equal windows meet whatever texts they stand in and neighbours with
the same least hash travel as one segment. Segments whose hash is alone in the corpus hold no repeat and aren't read again; equal segments
are represented by the first. Each shard of segments then gets a suffix array: suffixes are classified, leftmost-smaller substrings are
sorted by induction and recursively where two are alike, the array is induced in linear time, and permuted common prefixes give
every position's longest repeat. Nothing is sampled or capped: the result is that of comparing all windows with all.

No task holds more than a shard: where the different segments of one hash have more than ``HOT_TOKENS`` words, as with a passage in very many surroundings,
their windows are counted one by one by hashes of 128 bits instead, which gives the same result.

Defined results: null, empty and blank texts and texts of fewer than ``MIN_TOKENS`` words hold no passage; rows that repeat with the same
doc_id and text are reported once, with all their passages as repeated; of equal occurrences the one with the least doc_id (null first), then the earlier place, counts as the first; a passage that
repeats within one document is found too; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ROW_KEY, Scratch, read_table, row_key, sent_if_small

MIN_TOKENS = 50
GRAM = 8
SHARD_TOKENS = 60_000
HOT_TOKENS = 300_000
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; s ends with its unique least symbol."""
    n = len(s)
    small = np.zeros(n, bool)
    small[-1] = True
    if n > 1:
        differs = s[:-1] != s[1:]
        less = s[:-1] < s[1:]
        at = np.where(differs, np.arange(n - 1), n)
        first = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
        small[:-1] = less[np.minimum(first, n - 2)]
    return small


def suffix_array(s: np.ndarray) -> list[int]:
    """Suffix array of integers from 0 to max, the last of which is the unique least, by induced sorting."""
    n = len(s)
    if n == 1:
        return [0]
    small = classify(s)
    count = np.bincount(s)
    ends = np.cumsum(count)
    tails, heads = ends.tolist(), (ends - count).tolist()
    text, kind = s.tolist(), small.tolist()
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller suffixes
    order = left.tolist()

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        at = tails[:]
        for i in reversed(seeds):
            c = text[i]
            at[c] -= 1
            sa[at[c]] = i
        at = heads[:]
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not kind[j]:
                c = text[j]
                sa[at[c]] = j
                at[c] += 1
        at = tails[:]
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and kind[j]:
                c = text[j]
                at[c] -= 1
                sa[at[c]] = j
        return sa

    sa = induce(order)
    if len(order) > 1:
        is_left = np.zeros(n, bool)
        is_left[left] = True
        sorted_left = [i for i in sa if is_left[i]] if n < 64 else np.array(sa)[is_left[np.array(sa)]].tolist()
        stop = dict(zip(order, [x + 1 for x in order[1:]] + [n]))
        name, names, before = 0, {sorted_left[0]: 0}, text[sorted_left[0] : stop[sorted_left[0]]]
        for i in sorted_left[1:]:
            now = text[i : stop[i]]
            if now != before:
                name += 1
                before = now
            names[i] = name
        if name + 1 < len(order):
            reduced = np.array([names[i] for i in order], np.int64)
            sorted_left = [order[k] for k in suffix_array(reduced)]
        sa = induce(sorted_left)
    return sa


def permuted_prefixes(s: list[int], sa: list[int]) -> tuple[list[int], list[int]]:
    """(phi, plcp): for each position the suffix before it in the array, and how many symbols the two share."""
    n = len(s)
    phi = [-1] * n
    for a, b in zip(sa, sa[1:]):
        phi[b] = a
    plcp = [0] * n
    k = 0
    for i in range(n):
        j = phi[i]
        if j < 0:
            k = 0
            continue
        while s[i + k] == s[j + k]:
            k += 1
        plcp[i] = k
        if k:
            k -= 1
    return phi, plcp


def gram_hashes(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    g = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        g = g * _BASE + h[j : j + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def window_minima(g: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    size = 1
    while size * 2 <= w:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (w - size)], g[w - size :]) if w > size else g


def token_hashes(texts: list[str | None]) -> list[np.ndarray]:
    known: dict[str, int] = {}
    number = known.setdefault
    rows = [np.array([number(w, len(known)) for w in _WORD.findall(t.lower())], np.int64) if t else np.empty(0, np.int64) for t in texts]
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    return [table[r] for r in rows]


def segments(h: np.ndarray, least: int = MIN_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(least hash, first token, tokens, hash of all of them, times that the gram of the least hash occurs in the document) of the segments."""
    if len(h) < least:
        return []
    grams = gram_hashes(h)
    anchor = window_minima(grams, least - GRAM + 1)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([first, [len(anchor)]])) + least - 1
    out = []
    raw = h.tobytes()
    grams.sort()
    times = np.searchsorted(grams, anchor[first], "right") - np.searchsorted(grams, anchor[first])
    for a, i, n, m in zip(anchor[first].view(np.int64).tolist(), first.tolist(), size.tolist(), times.tolist()):
        out.append((a, i, n, xxhash.xxh64_intdigest(raw[8 * i : 8 * (i + n)]) - (1 << 63), m))
    return out


def _segment_rows(batches):
    kinds = [("anchor", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("content", pa.int64()), ("times", pa.int32())]
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            rows, owner = [], []
            for i, h in enumerate(token_hashes(b.column(3).to_pylist())):
                found = segments(h)
                rows += found
                owner += [i] * len(found)
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            mine = [b.column(c).take(pa.array(owner, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*mine, *[pa.array(c, t) for c, (_, t) in zip(cols, kinds)]], ["doc_id", "rid", "rows", *[k for k, _ in kinds]])


_WANTED = "doc_id long, rid " + ROW_KEY + ", anchor long, content long, copies long, start int"


def _cut(batches):
    """(columns of the document repeated for each segment that is wanted of it, its segments, their token hashes)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            owner, segs, toks = [], [], []
            for i, (own, h) in enumerate(zip(b.column("wanted").to_pylist(), token_hashes(b.column("text").to_pylist()))):
                for x in own:
                    owner.append(i)
                    segs.append(x)
                    toks.append(h[x["start"] : x["start"] + x["n"]])
            yield [b.column(c).take(pa.array(owner, pa.int64())) for c in ("doc_id", "rid")], segs, toks


def _columns(segs: list[dict]) -> list[pa.Array]:
    return [pa.array([x[k] for x in segs], t) for k, t in (("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("start", pa.int32()))]


_PARTS = _WANTED + ", tokens array<long>, k int, one long, two long"


def _segment_parts(batches):
    """The tokens of each segment or, where its hash has too many, a row for every window: its place, and two hashes of its words."""
    names = ["doc_id", "rid", "anchor", "content", "copies", "start", "tokens", "k", "one", "two"]
    for mine, segs, toks in _cut(batches):
        cols = [*mine, *_columns(segs)]
        cold = np.flatnonzero([not x["hot"] for x in segs])
        offsets = np.concatenate([[0], np.cumsum([len(toks[i]) for i in cold])]).astype(np.int32)
        values = np.concatenate([toks[i] for i in cold]) if len(cold) else np.empty(0, np.uint64)
        flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
        none = [pa.nulls(len(cold), t) for t in (pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(cold)) for c in cols), flat, *none], names)
        owner, place, one, two = [], [], [], []
        for i, (x, t) in enumerate(zip(segs, toks)):
            if x["hot"]:
                raw = t.tobytes()
                for k in range(len(t) - MIN_TOKENS + 1):
                    part = raw[8 * k : 8 * (k + MIN_TOKENS)]
                    owner.append(i)
                    place.append(k)
                    one.append(xxhash.xxh64_intdigest(part) - (1 << 63))
                    two.append(xxhash.xxh64_intdigest(part, 1) - (1 << 63))
        if owner:
            kinds = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner)) for c in cols), pa.nulls(len(owner), pa.list_(pa.int64())), *map(pa.array, (place, one, two), kinds)], names)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _spread(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """Tokens that lie in a window which begins at one of the marked places."""
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + least, -1)
    return np.cumsum(step[:-1]) > 0


def shard_repeats(segs: list[np.ndarray], rank: list, least: int = MIN_TOKENS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each segment two masks of window starts: those that occur elsewhere in the shard, and of them those that aren't the first.

    ``rank`` orders the segments: the first occurrence is in the segment of least rank, then at the least place.
    """
    repeated = [np.zeros(max(0, len(s) - least + 1), bool) for s in segs]
    later = [np.zeros(len(r), bool) for r in repeated]
    # a window can repeat only if all its grams do: pieces of such grams are what the array is built over
    grams = [gram_hashes(s) for s in segs]
    flat = np.concatenate(grams)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    pieces: list[tuple[int, int, int]] = []
    at = 0
    for k, g in enumerate(grams):
        for a, b in _runs(twice[at : at + len(g)]):
            if b - a >= least - GRAM + 1:
                pieces.append((k, a, b + GRAM - 1))
        at += len(g)
    if not pieces:
        return repeated, later
    symbols, ids = np.unique(np.concatenate([segs[k][a:b] for k, a, b in pieces]), return_inverse=True)
    size = len(pieces)
    text = np.empty(len(ids) + size + 1, np.int64)
    where_piece = np.full(len(text), -1)
    where_place = np.zeros(len(text), np.int64)
    at = done = 0
    for p, (k, a, b) in enumerate(pieces):
        n = b - a
        text[at : at + n] = ids[done : done + n] + size + 1
        text[at + n] = p + 1  # a separator of its own: no common prefix goes beyond a piece
        where_piece[at : at + n] = k
        where_place[at : at + n] = np.arange(a, b)
        at += n + 1
        done += n
    text[-1] = 0
    sa = suffix_array(text)
    phi, plcp = permuted_prefixes(text.tolist(), sa)
    order = np.array(sa)
    near = np.array(plcp)[order] >= least  # with the suffix before
    group = np.cumsum(~near)
    inside = near | np.concatenate([near[1:], [False]])
    order, group = order[inside], group[inside]
    if not len(order):
        return repeated, later
    k, place = where_piece[order], where_place[order]
    ranks = np.array(rank)[k] if not isinstance(rank, np.ndarray) else rank[k]
    best = np.lexsort((place, ranks, group))
    lead = np.ones(len(best), bool)
    lead[1:] = group[best][1:] != group[best][:-1]
    for i, first in zip(best.tolist(), lead.tolist()):
        repeated[k[i]][place[i]] = True
        if not first:
            later[k[i]][place[i]] = True
    return repeated, later


def _find(batches):
    """Rows sorted by anchor; an anchor is never split over two shards."""
    held: list[tuple] = []
    size = 0

    def flush():
        segs = [h[3] for h in held]
        rank = np.empty(len(held), np.int64)
        rank[sorted(range(len(held)), key=lambda i: held[i][4])] = np.arange(len(held))
        out = []
        for (anchor, content, copies, tokens, _), rep, late in zip(held, *shard_repeats(segs, rank)):
            n = len(tokens)
            whole = np.ones(n, bool) if copies > 1 else _spread(rep, n, MIN_TOKENS)
            spans = [{"a": a, "b": b} for a, b in _runs(whole)]
            if spans:
                out.append((anchor, content, spans, [{"a": a, "b": b} for a, b in _runs(_spread(late, n, MIN_TOKENS))]))
        held.clear()
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind, kind))], ["anchor", "content", "repeated", "later"])

    last = None
    for b in batches:
        lists = b.column("tokens")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        rid = b.column("rid")
        first = zip(b.column("doc_id").to_pylist(), zip(rid.field("a").to_pylist(), rid.field("b").to_pylist()), b.column("start").to_pylist())
        for i, (a, c, m, f) in enumerate(zip(b.column("anchor").to_pylist(), b.column("content").to_pylist(), b.column("copies").to_pylist(), first)):
            if a != last and size >= SHARD_TOKENS:
                yield flush()
                size = 0
            last = a
            t = values[offsets[i] : offsets[i + 1]].view(np.uint64)
            held.append((a, c, m, t, (f[0] is not None, f[0] or 0, f[1], f[2])))
            size += len(t)
    if held:
        yield flush()


def _union_sql(name: str) -> str:
    """Overlapping or touching spans of a sorted array joined."""
    return f"""aggregate(array_sort({name}), cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
      case when size(acc) > 0 and x.start <= element_at(acc, -1).end
      then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
      else concat(acc, array(named_struct('start', x.start, 'end', x.end))) end)"""


_SPANS = "array<struct<a:int,b:int>>"


def _different(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, rid, rows (how often the row occurs), text, each row once. Only rows that repeat are grouped, each task passing on one of them at most."""
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("rid"), "text")
    twice = scratch.table(keyed.groupBy("rid").agg(F.count("*").alias("rows")).filter("rows > 1"), "twice")
    few = sent_if_small(twice)
    once = keyed.join(few.select("rid"), "rid", "left_anti").select("doc_id", "rid", F.lit(1).cast("long").alias("rows"), "text")
    again = keyed.join(few, "rid").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("rows").alias("rows"), F.first("text").alias("text"))
    return once.unionByName(scratch.table(again, "again"))


def _hot_found(windows: DataFrame, reps: DataFrame) -> DataFrame:
    """What ``_find`` finds, for segments whose hash has too many: by counting windows."""
    same = windows.groupBy("one", "two").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "rid", "start", "k")).alias("f")).filter("c > 1")
    is_first = (F.col("rid") == F.col("f.rid")) & (F.col("start") == F.col("f.start")) & (F.col("k") == F.col("f.k"))
    span = F.struct(F.col("k").alias("a"), (F.col("k") + MIN_TOKENS).alias("b"))
    spans = windows.join(same, ["one", "two"]).groupBy("anchor", "content").agg(F.collect_list(span).alias("r"), F.collect_list(F.when(~is_first, span)).alias("later"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    out = reps.select("anchor", "content", "copies", "n").join(spans, ["anchor", "content"], "left")
    none = F.array().cast(_SPANS)
    return out.select("anchor", "content", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("r", none)).alias("repeated"), F.coalesce("later", none).alias("later")).filter(F.size("repeated") > 0)


def repeated_passages(spark: SparkSession, docs: DataFrame, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """Documents with a repeated passage: doc_id, repeated and removable (spans of tokens, end exclusive), n_repeated, n_removable.

    ``removable`` is what goes when of all equal passages the first stays.
    """
    scratch = Scratch(spark, "suffix")
    keyed = _different(docs, scratch)
    fields = f"doc_id long, rid {ROW_KEY}, rows long, anchor long, start int, n int, content long, times int"
    seg = scratch.table(keyed.mapInArrow(_segment_rows, fields), "segments")
    shared = seg.groupBy("anchor").agg(F.sum("rows").alias("c"), F.max("times").alias("m")).filter("c > 1 or m > 1").select("anchor")
    seg = scratch.table(seg.join(shared, "anchor"), "shared")
    scratch.drop("segments")
    reps = seg.groupBy("anchor", "content").agg(F.sum("rows").alias("copies"), F.min(F.struct("doc_id", "rid", "start", "n")).alias("r"))
    reps = scratch.table(reps.select("anchor", "content", "copies", "r.*"), "reps")
    hot = reps.groupBy("anchor").agg((F.sum("n") > hot_tokens).alias("hot"))
    reps = scratch.table(reps.join(hot, "anchor"), "judged")
    scratch.drop("reps")
    wanted = reps.groupBy("rid").agg(F.collect_list(F.struct("anchor", "content", "copies", "start", "n", "hot")).alias("wanted"))
    texts = keyed.join(wanted, "rid").select("doc_id", "rid", "text", "wanted")
    parts = scratch.table(texts.mapInArrow(_segment_parts, _PARTS), "parts")
    tokens = parts.filter("k is null").select("anchor", "content", "copies", "tokens", "doc_id", "rid", "start")
    found = tokens.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(_find, f"anchor long, content long, repeated {_SPANS}, later {_SPANS}")
    many = reps.filter("hot")
    if many.limit(1).count():
        found = found.unionByName(_hot_found(parts.filter("k is not null").drop("tokens"), many))
    found = scratch.table(found, "found")
    scratch.drop("parts")
    first = reps.select("anchor", "content", F.col("rid").alias("_rid"), F.col("start").alias("_start"))
    hits = seg.join(found.join(first, ["anchor", "content"]), ["anchor", "content"])
    is_first = (F.col("rid") == F.col("_rid")) & (F.col("start") == F.col("_start"))
    move = lambda c: F.transform(c, lambda x: F.struct((x["a"] + F.col("start")).alias("start"), (x["b"] + F.col("start")).alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    hits = hits.select("doc_id", "rid", move(F.col("repeated")).alias("r"), move(F.when(is_first, F.col("later")).otherwise(whole)).alias("d"))
    per = hits.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("r")).alias("r"), F.flatten(F.collect_list("d")).alias("d"))
    out = per.select("doc_id", F.expr(_union_sql("r")).alias("repeated"), F.expr(_union_sql("d")).alias("removable"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "repeated", "removable", total("repeated").alias("n_repeated"), total("removable").alias("n_removable"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as text, first to last word with the end exclusive: 3-60,100-160."""
    out = repeated_passages(spark, read_table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias(c)
    return out.select("doc_id", text("repeated"), text("removable"), F.col("n_repeated").cast("long").alias("n_repeated"), F.col("n_removable").cast("long").alias("n_removable"))


def _spans_sql(which: str) -> str:
    """Windows that overlap or touch, as one span each, of every row."""
    return f"""(SELECT r, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS n FROM (
        SELECT r, island, min(i) AS a, max(i) + {MIN_TOKENS} AS b FROM (
          SELECT r, i, sum(step) OVER (PARTITION BY r ORDER BY i) AS island FROM (
            SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {MIN_TOKENS} THEN 0 ELSE 1 END AS step FROM same WHERE {which}))
        GROUP BY r, island) GROUP BY r)"""


#: All windows with all.
OP1_SQL = rf"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, * FROM (SELECT doc_id, text, count(*) AS copies FROM documents GROUP BY ALL)),
  w AS (SELECT r, doc_id, copies, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM d),
  v AS (SELECT r, copies, i, md5(array_to_string(w[i + 1:i + {MIN_TOKENS}], ' ')) AS k FROM (SELECT r, copies, w, unnest(range(len(w) - {MIN_TOKENS - 1})) AS i FROM w WHERE len(w) >= {MIN_TOKENS})),
  same AS (SELECT r, i, sum(copies) OVER (PARTITION BY k) > 1 AS repeated, row_number() OVER (PARTITION BY k ORDER BY r, i) > 1 AS later FROM v)
  SELECT d.doc_id, a.spans AS repeated, coalesce(b.spans, '') AS removable, a.n AS n_repeated, coalesce(b.n, 0) AS n_removable
  FROM {_spans_sql("repeated")} a JOIN d USING (r) LEFT JOIN {_spans_sql("later")} b USING (r)"""
