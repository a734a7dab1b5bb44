"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

Texts are encoded once, with the tokenizer of ``token_files``, and packed by their tokens. Documents are split over shards by a hash; each shard is packed by
``ISLANDS`` islands that evolve side by side as tasks. An individual is a
packing, its genes are whole bins. Crossover injects well-filled bins of one parent into the other, removes the bins that then hold a
document twice, and puts the displaced documents back: they change places with smaller ones where that fills a bin better, the rest by best fit; mutation
empties ill-filled bins. After every epoch each island hands its best
packing to the next island of its shard (a shuffle of the elites only). An island evolves until ``PATIENCE`` generations bring nothing, a shard until an epoch
brings nothing; a packing that needs no more bins than any packing must is left as it is. In the end the best island's packing counts.

A document longer than a bin is cut into full bins and a remainder, which is packed like any other piece. The bins carry their tokens, so nothing else is
needed to train on them: little-endian ids of two bytes, or of four with a tokenizer of more than 65,536.

Defined results: null, empty and blank texts go in no bin; a null doc_id is packed like any other; repeated rows are packed
as often as they occur, spread over the shards; of documents of one size the one that is read first goes first; which documents share a bin depends on how the
table is split over tasks; an empty table gives no bins; further columns are ignored.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, read_table
from corpusloom.llm.token_files import TOKENIZER, encoder

CAPACITY = 4096
SHARD_DOCS = 2000
ISLANDS = 2
PATIENCE = 15
POPULATION = 6
#: Bins of more documents than this have no pairs tried against single ones.
PAIRED = 12

Packing = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Packing, loads: list[int], capacity: int) -> None:
    """Puts the items, longest first, each into the fullest bin with room; opens bins where none has. Changes bins and loads."""
    order = sorted((capacity - load, k) for k, load in enumerate(loads) if load < capacity)
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(order, (sizes[i], -1))
        if at == len(order):
            bins.append([i])
            loads.append(sizes[i])
            k = len(bins) - 1
        else:
            _, k = order.pop(at)
            bins[k].append(i)
            loads[k] += sizes[i]
        if loads[k] < capacity:
            insort(order, (capacity - loads[k], k))


def pack(sizes: list[int], items: list[int], capacity: int, kept: Packing | None = None) -> Packing:
    bins = [list(b) for b in kept] if kept else []
    best_fit(sizes, items, bins, [sum(sizes[i] for i in b) for b in bins], capacity)
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer: by the sum, and by what is longer than half a bin."""
    return max(-(-sum(sizes) // capacity), sum(1 for x in sizes if 2 * x > capacity))


def fitness(sizes: list[int], bins: Packing, capacity: int) -> float:
    """Mean of the squared fill of the bins: fewer and fuller bins are fitter."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 0.0


def exchange(sizes: list[int], bins: Packing, loose: list[int], capacity: int, r: random.Random) -> list[int]:
    """Swaps one or two documents of a bin for a longer loose one where that fills the bin better; what is loose then. Changes the bins."""
    if not loose:
        return loose
    order = sorted((sizes[i], i) for i in loose)
    for b in r.sample(bins, len(bins)):
        room = capacity - sum(sizes[i] for i in b)
        if not room:
            continue
        best, gain = None, 0
        single = [(i,) for i in b]
        pairs = [(i, k) for n, i in enumerate(b) for k in b[n + 1 :]] if len(b) <= PAIRED else []
        for out in [(), *single, *pairs]:
            size = sum(sizes[i] for i in out)
            at = bisect_right(order, (size + room, len(sizes))) - 1
            if at >= 0 and order[at][0] - size > gain:
                best, gain = (out, order[at]), order[at][0] - size
        if best:
            out, new = best
            order.remove(new)
            for i in out:
                b.remove(i)
                insort(order, (sizes[i], i))
            b.append(new[1])
            if not order:
                break
    return [i for _, i in order]


def crossover(sizes: list[int], a: Packing, b: Packing, capacity: int, r: random.Random) -> Packing:
    """The fullest bins of b, each with a chance of a half among the fullest half, are injected into a."""
    by_fill = sorted(b, key=lambda g: -sum(sizes[i] for i in g))
    injected = [g for g in by_fill[: max(1, len(b) // 2)] if r.random() < 0.5] or by_fill[:1]
    taken = {i for g in injected for i in g}
    kept = [list(g) for g in a if taken.isdisjoint(g)]
    loose = [i for g in a if not taken.isdisjoint(g) for i in g if i not in taken]
    bins = [*map(list, injected), *kept]
    return pack(sizes, exchange(sizes, bins, loose, capacity, r), capacity, bins)


def mutate(sizes: list[int], a: Packing, capacity: int, r: random.Random) -> Packing:
    """The emptiest bins and a few at random are taken apart; their documents go back by exchange and best fit."""
    order = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    out = set(order[: max(1, len(a) // 20)]) | set(r.sample(range(len(a)), min(len(a), max(1, len(a) // 10))))
    loose = [i for k in out for i in a[k]]
    r.shuffle(loose)
    bins = [list(g) for k, g in enumerate(a) if k not in out]
    return pack(sizes, exchange(sizes, bins, loose, capacity, r), capacity, bins)


def evolve(sizes: list[int], elites: list[Packing], capacity: int, seed: int, patience: int = PATIENCE, population: int = POPULATION) -> Packing:
    """The best packing of one island after an epoch that starts from the elites."""
    r = random.Random(seed)
    everyone = [*elites] or [pack(sizes, list(range(len(sizes))), capacity)]
    least = least_bins(sizes, capacity)
    for p in everyone:
        if len(p) <= least:
            return p
    while len(everyone) < population:
        order = list(range(len(sizes)))
        r.shuffle(order)
        bins = pack(sizes, order[len(order) // 3 :], capacity)
        everyone.append(pack(sizes, order[: len(order) // 3], capacity, bins))
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(everyone)), reverse=True)
    made, idle = len(scored), 0
    while idle < patience and len(scored[0][2]) > least:
        a = max(r.sample(scored, 2))[2]
        b = max(r.sample(scored, 2))[2]
        child = crossover(sizes, a, b, capacity, r)
        if r.random() < 0.5:
            child = mutate(sizes, child, capacity, r)
        best = scored[0][0]
        scored.append((fitness(sizes, child, capacity), made, child))
        made += 1
        scored.sort(reverse=True)
        scored.pop()
        idle = 0 if scored[0][0] > best + 1e-12 else idle + 1
    return scored[0][2]


_PIECE = "doc_id long, piece int, start int, size int, tokens binary"
_BIN = "bin_id string, fill int, n_docs int, doc_ids array<long>, pieces array<struct<doc_id:long,piece:int,start:int,size:int>>, tokens binary"
_BIN_FIELDS = [("bin_id", pa.string()), ("fill", pa.int32()), ("n_docs", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("size", pa.int32())]))), ("tokens", pa.binary())]


def _pieces(tokenizer: str, capacity: int):
    def run(batches):
        enc = encoder(tokenizer)
        kind = "<u2" if enc.n_vocab <= 1 << 16 else "<u4"
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                rows = []
                for doc_id, text in zip(*(whole.slice(at, 200).column(c).to_pylist() for c in (0, 1))):
                    if text and not text.isspace():
                        ids = np.array(enc.encode_ordinary(text), kind)
                        rows += [(doc_id, k, start, len(cut), cut.tobytes()) for k, start in enumerate(range(0, len(ids), capacity)) for cut in [ids[start : start + capacity]]]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "piece", "start", "size", "tokens"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start and size in tokens, tokens: full pieces of long documents and remainders."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), _PIECE)


def ids_of(tokens: bytes, tokenizer: str = TOKENIZER) -> np.ndarray:
    """The token ids of a bin."""
    return np.frombuffer(tokens, "<u2" if encoder(tokenizer).n_vocab <= 1 << 16 else "<u4")


def _bins(named: list[tuple[str, list[dict]]]) -> list[pa.Array]:
    """Columns of bins from the pieces of each."""
    rows = []
    for name, mine in named:
        short = [{k: p[k] for k in ("doc_id", "piece", "start", "size")} for p in mine]
        rows.append((name, sum(p["size"] for p in mine), len(mine), [p["doc_id"] for p in mine], short, b"".join(p["tokens"] for p in mine)))
    cols = list(zip(*rows)) if rows else [[]] * len(_BIN_FIELDS)
    return [pa.array(c, t) for c, (_, t) in zip(cols, _BIN_FIELDS)]


def _alone(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            rows = whole.slice(at, 200).to_pylist()
            yield pa.RecordBatch.from_arrays(_bins([(f"full-{r['id']}", [r]) for r in rows]), [n for n, _ in _BIN_FIELDS])


def _filled(items: pa.Table, chosen: pa.Table) -> pa.Table:
    """The bins of a shard from its pieces and where each goes."""
    rows = items.sort_by("id").to_pylist()
    bins: dict[int, list[dict]] = {}
    for item, k in sorted(zip(chosen.column("item").to_pylist(), chosen.column("bin").to_pylist()), key=lambda x: (x[1], x[0])):
        bins.setdefault(k, []).append(rows[item])
    return pa.Table.from_arrays(_bins([(f"{mine[0]['shard']}-{k}", mine) for k, mine in bins.items()]), [n for n, _ in _BIN_FIELDS])


_STATE = "shard long, island int, item int, size int, bin int, score double, open boolean"


def _island(capacity: int, epoch: int, patience: int, population: int):
    """One island's epoch. Rows of a group: the shard's items (kind 0), and elites as item to bin assignments (kind 1 and up)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(rows.shard.iloc[0]), int(rows.island.iloc[0])
        rows = rows.sort_values(["kind", "item"], kind="stable")
        sizes = rows.loc[rows.kind == 0, "size"].tolist()
        elites = []
        for _, e in rows[rows.kind > 0].groupby("kind", sort=True):
            bins: dict[int, list[int]] = {}
            for i, b in zip(e["item"].tolist(), e["bin"].tolist()):
                bins.setdefault(b, []).append(i)
            elites.append(list(bins.values()))
        best = evolve(sizes, elites, capacity, shard * 1_000_003 + island * 101 + epoch, patience, population)
        score = fitness(sizes, best, capacity)
        before = max((fitness(sizes, e, capacity) for e in elites), default=-1.0)
        more = len(best) > least_bins(sizes, capacity) and score > before + 1e-12
        out = [(shard, island, i, sizes[i], k, score, more) for k, b in enumerate(best) for i in b]
        return pd.DataFrame(out, columns=["shard", "island", "item", "size", "bin", "score", "open"])

    return run


def pack_documents(
    spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, shard_docs: int = SHARD_DOCS, patience: int = PATIENCE, population: int = POPULATION, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Bins: bin_id, fill (tokens), n_docs, doc_ids, pieces (doc_id, piece, start and size in tokens), tokens (of the pieces, one after the other; see ``ids_of``)."""
    scratch = Scratch(spark, "packing")
    # written, so that the ids stay; tokens are read once more, when the bins are filled
    all_pieces = scratch.table(pieces(docs, capacity, tokenizer).withColumn("id", F.monotonically_increasing_id()), "pieces", "zstd")
    rest = all_pieces.filter(F.col("size") < capacity)
    shards = max(1, -(-rest.count() // shard_docs))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    items = rest.select(shard, "id", "size").withColumn("item", F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1)
    items = scratch.table(items.select("shard", "item", "size"), "items")
    spread = items.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("kind"), "item", "size", F.lit(-1).alias("bin"))
    run = lambda rows, epoch: rows.groupBy("shard", "island").applyInPandas(_island(capacity, epoch, patience, population), _STATE)
    state = scratch.table(run(spread, 0), "epoch0")
    epoch = 0
    while islands > 1 and (going := state.filter("open").select("shard").distinct()).limit(1).count():
        epoch += 1
        own = state.select("shard", "island", F.lit(1).alias("kind"), "item", "size", "bin")
        guest = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.lit(2).alias("kind"), "item", "size", "bin")
        again = run(spread.unionByName(own).unionByName(guest).join(going, "shard", "left_semi"), epoch)
        state = scratch.table(state.join(going, "shard", "left_anti").withColumn("open", F.lit(False)).unionByName(again), f"epoch{epoch}")
        scratch.drop(f"epoch{epoch - 1}")
    best = state.groupBy("shard").agg(F.max(F.struct("score", (-F.col("island")).alias("x"))).alias("b")).select("shard", (-F.col("b.x")).alias("island"))
    chosen = state.join(best, ["shard", "island"]).select("shard", "item", "bin")
    packed = rest.select(shard, "id", *[c.split()[0] for c in _PIECE.split(", ")]).groupBy("shard").cogroup(chosen.groupBy("shard")).applyInArrow(_filled, _BIN)
    return packed.unionByName(all_pieces.filter(F.col("size") == capacity).mapInArrow(_alone, _BIN))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents."""
    return pack_documents(spark, read_table(spark, sf_dir, "documents"))
