"""SimHash near-duplicates found by pigeonhole blocks.

A document's distinct words, weighted by length, give a fingerprint of ``BLOCKS * WIDTH`` bits: the signs of as many sums of numbers that
hashes of the words give. It is split into blocks; two fingerprints that differ in fewer than ``BLOCKS`` bits must agree in a whole block.
Pairs beyond that, up to ``MAX_DISTANCE``, differ nearly always where a sum is close to zero, so each document takes the ``PROBES`` least certain
bits of every block both ways: a pair meets wherever a block differs in uncertain bits of either only. The tests measure recall
against all pairs, by distance. Documents are joined on blocks; pairs within a block are verified by
Hamming distance, but only edges that span what they connect are passed on, so that a group of thousands costs its members
and not its pairs. Connected components of those edges are the groups, and the smallest doc_id of a group is kept.

Blocks with the same members are looked at once. One of more than ``HOT`` members is held by no task: its members are compared with a few
pivots, those near none with all others, and those near pivots that nothing links with all of the other side that the triangle inequality leaves, in parts of
bounded size. Either way a block connects what all its pairs within the limit connect.

Defined results: null, empty and blank texts have no fingerprint and are never grouped; short texts follow the same rule as long ones, so a text of
one word is a near copy only of texts of that word; repeated rows (same doc_id and text) count as one document of
which one row stays, the least by its other columns (null first; columns without an order don't count); of equal doc_ids the row
with the least key of doc_id and text is kept; a null doc_id sorts first; further columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ROW_KEY, Scratch, fresh, read_table, row_key, sent_if_small

WIDTH = 32
BLOCKS = 24
BITS = WIDTH * BLOCKS
PROBES = 3
MAX_DISTANCE = 120
#: Members of a block that one task holds at most, and pivots that those of a larger block are compared with.
HOT, PIVOTS = 5000, 16
_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, BITS // 16 + 1, dtype=np.uint64) * _GOLD


def numbers(words: list[str]) -> np.ndarray:
    """A row of BITS odd numbers from -15 to 15, times the word's length (8 at most), for each word.

    Numbers and not signs: of few words, the heaviest doesn't decide every bit, so that distances follow angles for short texts too.
    """
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    raw = _mix(h[:, None] + _STEPS[None, :]).view(np.int8)
    out = np.empty((len(words), BITS), np.int8)
    out[:, ::2] = raw & 15
    out[:, 1::2] = (raw >> 4) & 15
    out *= 2
    out -= 15
    out *= np.fromiter((min(len(w), 8) for w in words), np.int8, len(words))[:, None]
    return out


def fingerprints(texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
    """(fingerprint, the places of the least certain bits of each block, a byte each); None for a text without words."""
    known: dict[str, int] = {}
    rows: list[list[int] | None] = []
    for t in texts:
        words = _WORD.findall(t.lower()) if t else []
        if not words and t and not t.isspace():
            words = t.split()
        rows.append([known.setdefault(w, len(known)) for w in dict.fromkeys(words)] if words else None)
    table = numbers(list(known)) if known else None
    out: list[tuple[bytes, bytes] | None] = []
    for r in rows:
        if r is None:
            out.append(None)
            continue
        total = np.zeros(BITS, np.int32)
        for at in range(0, len(r), 270):  # of at most 120 each: no sum leaves 16 bits
            total += np.add.reduce(table[r[at : at + 270]], axis=0, dtype=np.int16)
        weak = np.argsort(np.abs(total).reshape(BLOCKS, WIDTH), axis=1, kind="stable")[:, :PROBES]
        out.append((np.packbits(total > 0).tobytes(), weak.astype(np.uint8).tobytes()))
    return out


def _fingerprint_rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, 400):
            part = b.slice(at, 400)
            found = fingerprints(part.column(2).to_pylist())
            fp, weak = (pa.array([f and f[k] for f in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fp, weak], ["doc_id", "rid", "fp", "weak"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rid (key of the row), fp, weak."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("rid"), "text")
    return rows.mapInArrow(_fingerprint_rows, f"doc_id long, rid {ROW_KEY}, fp binary, weak binary").filter("fp is not null")


def block_keys(fps: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, a row each: every block with its uncertain bits set each way, and the block's number."""
    n = len(fps)
    value = fps.reshape(n, BLOCKS, WIDTH // 8).astype(np.uint64)
    block = np.zeros((n, BLOCKS), np.uint64)
    for i in range(WIDTH // 8):
        block = block << np.uint64(8) | value[:, :, i]
    bit = np.uint64(1) << (np.uint64(WIDTH - 1) - weak.reshape(n, BLOCKS, PROBES).astype(np.uint64))
    block &= ~np.bitwise_or.reduce(bit, axis=2)
    keys = block[:, :, None]
    for p in range(PROBES):
        keys = np.concatenate([keys, keys | bit[:, :, p : p + 1]], axis=2)
    return (keys | (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(WIDTH))[None, :, None]).reshape(n, -1).view(np.int64)


def _keyed(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            fps, weak = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("fp", "weak"))
            keys = block_keys(fps, weak)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), keys.shape[1]))], ["key", "id"])


def block_components(fps: np.ndarray, limit: int = MAX_DISTANCE) -> np.ndarray:
    """For each fingerprint (rows of bytes), the first row that it is connected to by pairs within the limit.

    A search from each unlabelled row: a row is compared only with those not yet reached, so a tight group of n costs n.
    """
    n = len(fps)
    label = np.arange(n)
    spread = lambda rows: np.unpackbits(fps[rows], axis=1).astype(np.float32) * 2 - 1
    left = np.arange(n)
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            some, front = spread(front[:256]), front[256:]
            hit = np.zeros(len(left), bool)
            for at in range(0, len(left), 4096):
                hit[at : at + 4096] = (some @ spread(left[at : at + 4096]).T >= BITS - 2 * limit).any(axis=0)
            label[left[hit]] = seed
            front = np.concatenate([front, left[hit]])
            left = left[~hit]
    return label


def _edges(batches):
    """Edges (a, b) from rows sorted by key: each member of a block component with the component's first member."""
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        ids = t.column("id").to_numpy()
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(len(ids), -1)
        cuts = np.flatnonzero(np.diff(key)) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
            if hi - lo == 2:
                x = np.bitwise_xor(fps[lo], fps[lo + 1])
                if int(np.bitwise_count(x).sum()) <= MAX_DISTANCE:
                    a.append(ids[lo])
                    b.append(ids[lo + 1])
            elif hi - lo > 2:
                label = block_components(fps[lo:hi])
                other = np.flatnonzero(label != np.arange(hi - lo))
                a.extend(ids[lo + label[other]])
                b.extend(ids[lo + other])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        while batch.num_rows:
            key = batch.column("key").to_numpy()
            last = key[-1]
            start = int(np.searchsorted(key, last, "left"))
            if start == 0 and held and held[-1].column("key")[-1].as_py() == last:
                held.append(batch)
                break
            if held or start:
                if start:
                    held.append(batch.slice(0, start))
                if held:
                    yield flush()
                    held.clear()
            held.append(batch.slice(start))
            break
    if held:
        yield flush()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """(id, root): every node with the least node of its component, by alternating large-star and small-star steps."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    now = scratch.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star0")
    for i in range(1, max_rounds + 1):
        low = both(now).groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both(now).join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()
        )
        large = scratch.table(large, f"large{i}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        small = scratch.table(small, f"star{i}")
        # stable when every node hangs on exactly one root and no root hangs on anything
        n, ids = small.agg(F.count("*"), F.count_distinct("a")).first()
        loose = small.select(F.col("b").alias("a")).join(small.select("a"), "a", "left_semi").limit(1).count() if n == ids else 1
        scratch.drop(f"large{i}")
        scratch.drop(f"star{i - 1}")
        now = small
        if not loose:
            break
    else:
        raise RuntimeError("connected components didn't settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


_PIVOTED = "key long, id long, fp binary, near long, close long, to array<long>"


def _near_pivots(batches):
    """Members of hot blocks: the block's pivots within the limit and within twice the limit, a bit each, and the ids of the first."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            pivots = b.column("pivots")
            each = pivots.flatten()
            ids, pivot_fps = each.field("id").to_numpy(), np.frombuffer(b"".join(each.field("fp").to_pylist()), np.uint8).reshape(len(each), -1)
            size = pivots.value_lengths().to_numpy()
            first = np.cumsum(size) - size
            near, close = np.zeros((2, b.num_rows), np.int64)
            row, to = [], []
            for k in range(size.max(initial=0)):
                has = np.flatnonzero(size > k)
                d = np.bitwise_count(np.bitwise_xor(fps[has], pivot_fps[first[has] + k])).sum(axis=1, dtype=np.int64)
                near[has] |= (d <= MAX_DISTANCE).astype(np.int64) << k
                close[has] |= (d <= 2 * MAX_DISTANCE).astype(np.int64) << k
                row.append(has[d <= MAX_DISTANCE])
                to.append(ids[first[row[-1]] + k])
            row, to = np.concatenate(row), np.concatenate(to)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(to[np.argsort(row, kind="stable")], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("fp"), pa.array(near), pa.array(close), lists], ["key", "id", "fp", "near", "close", "to"])


def pivot_groups(masks: list[int]) -> list[int]:
    """Sets of pivots (a bit each) joined where they share one."""
    groups: list[int] = []
    for m in masks:
        apart = []
        for g in groups:
            if g & m:
                m |= g
            else:
                apart.append(g)
        groups = [*apart, m]
    return groups


def _grouped(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([pivot_groups(m) for m in b.column("masks").to_pylist()], pa.list_(pa.int64()))], ["key", "groups"])


def _across(left: DataFrame, right: DataFrame, by: list[str], hot: int) -> DataFrame:
    """Edges of all rows of the one with all rows of the other that have the same ``by``, in parts of bounded size."""
    count = lambda rows, name: rows.groupBy(*by).agg(F.ceil(F.count("*") / hot).alias(name))
    parts = count(left, "i").join(count(right, "j"), by)
    part = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    rows = left.join(parts, by).select(*by, "id", "fp", part("i").alias("x"), every("j").alias("y"))
    others = right.join(parts, by).select(*by, "id", "fp", every("i").alias("x"), part("j").alias("y"))
    return _block_edges(rows.unionByName(others).select(F.xxhash64(*by, "x", "y").alias("key"), "id", "fp").distinct())


def _hot_edges(members: DataFrame, scratch: Scratch, hot: int, pivots: int) -> DataFrame:
    """Edges that span what all pairs within the limit span, of blocks of more than ``hot`` members. members: key, id, fp.

    Members near a pivot are linked to it, and pivots that share one are a group. A member of another group can be within the limit of one near a pivot only if
    it is itself within twice the limit of that pivot, so all such members of either group meet. Those near no pivot meet the whole block.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(pivots)).alias("slot")
    some = members.groupBy("key", slot).agg(F.min(F.struct(F.xxhash64(F.lit(7), "id").alias("h"), "id", "fp")).alias("p"))
    some = scratch.table(some.groupBy("key").agg(F.collect_list(F.struct("p.id", "p.fp")).alias("pivots")), "pivots")
    told = scratch.table(members.join(some, "key").mapInArrow(_near_pivots, _PIVOTED), "told")
    edges = told.select(F.explode("to").alias("a"), F.col("id").alias("b"))
    near, far = told.filter("near <> 0"), told.filter("near = 0")
    groups = near.groupBy("key").agg(F.collect_set("near").alias("masks")).mapInArrow(_grouped, "key long, groups array<long>").filter("size(groups) > 1")
    sides = near.join(scratch.table(groups, "groups"), "key").withColumn("mine", F.expr("array_position(transform(groups, g -> near & g <> 0), true) - 1"))
    sides = sides.select("key", "id", "fp", "mine", "close", F.posexplode("groups").alias("other", "g")).filter("other <> mine and close & g <> 0")
    sides = scratch.table(sides.select("key", "id", "fp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).alias("upper")), "sides")
    edges = edges.unionByName(_across(sides.filter("not upper"), sides.filter("upper"), ["key", "lo", "hi"], hot))
    return edges.unionByName(_across(members, far, ["key"], hot)).filter("a <> b")


def _block_edges(members: DataFrame) -> DataFrame:
    rows = members.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "fp")
    return rows.mapInArrow(_edges, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, hot: int = HOT, pivots: int = PIVOTS) -> DataFrame:
    """Every document of a group of two or more: doc_id, rid, keep_id, keep_rid; the kept one has its own."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.table(with_fingerprints(docs), "rows")
    # documents with the same fingerprint are one node; only nodes are searched. The table is written, so that the ids stay
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("weak").alias("weak")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("id", "fp", "weak").mapInArrow(_keyed, "key long, id long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    hits = scratch.table(keyed.join(shared, "key"), "hits")
    # of blocks with the same members one is looked at: members are told by two hashes and their number
    of = hits.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    blocks = scratch.table(of.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "blocks")
    members = lambda which: hits.join(blocks.filter(which).select("key"), "key").join(nodes.select("id", "fp"), "id").select("key", "id", "fp")
    edges = _block_edges(members(F.col("n") <= hot))
    large = blocks.filter(F.col("n") > hot)
    if large.limit(1).count():
        edges = edges.unionByName(_hot_edges(scratch.table(members(F.col("n") > hot), "hot"), scratch, hot, pivots))
    edges = scratch.table(edges.distinct(), "edges")
    for name in ("hits", "blocks"):
        scratch.drop(name)
    roots = connected_components(edges, scratch)
    members = (
        rows.join(nodes.select("fp", "id"), "fp").join(roots, "id", "left").select("doc_id", "rid", F.coalesce("root", "id").alias("root")).distinct()
    )
    members = scratch.table(members, "members")
    for name in ("rows", "nodes", "edges"):
        scratch.drop(name)
    keep = members.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("k")).filter("n > 1")
    return members.join(keep, "root").select("doc_id", "rid", F.col("k.doc_id").alias("keep_id"), F.col("k.rid").alias("keep_rid"))


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def near_dedup_filter(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group, with the columns they came with.

    Texts aren't shuffled while the keys of what goes are few enough to be sent to the workers; only rows that repeat are grouped.
    """
    scratch = Scratch(spark, "simhash-gone")
    rid, one = fresh(docs, "_simhash_rid"), fresh(docs, "_simhash_one")
    keyed = docs.withColumn(rid, row_key("doc_id", "text"))
    gone = near_duplicates(spark, docs).filter("rid <> keep_rid").select("rid")
    gone = scratch.table(gone, "gone")
    twice = keyed.groupBy(F.col(rid).alias("rid")).agg(F.count("*").alias("n")).filter("n > 1").select("rid")
    twice = scratch.table(twice.join(gone, "rid", "left_anti"), "twice")
    apart = scratch.table(gone.unionByName(twice), "apart")
    named = lambda keys: sent_if_small(keys).withColumnRenamed("rid", rid)
    rest = keyed.join(named(apart), rid, "left_anti")
    order = F.struct(*[F.col(f.name) for f in docs.schema.fields if _ordered(f.dataType)])
    whole = F.struct(*[F.col(c) for c in docs.columns])
    firsts = keyed.join(named(twice), rid, "left_semi").groupBy(rid).agg(F.min_by(whole, order).alias(one)).select(f"{one}.*")
    return rest.select(*docs.columns).unionByName(firsts)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the document that stays and each that goes: keep_id, doc_id."""
    return near_duplicates(spark, read_table(spark, sf_dir, "documents")).filter("rid <> keep_rid").select("keep_id", "doc_id")
