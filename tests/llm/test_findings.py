"""Cases in which operators once did less than the whole job."""

import numpy as np
import pytest

from corpusloom.llm import brown, decontaminate, simhash, toxicity
from corpusloom.llm.common import ROW_KEY, Scratch
from tests.llm.conftest import prose


def test_every_repeated_word_is_clustered_at_any_size(spark):
    """More words than the reciprocal of any fixed share of tokens, each seen but two or three times."""
    texts = [" ".join(f"w{chr(97 + i % 26)}{i}x" for i in range(k, k + 300)) for k in range(0, 60_000, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts, *texts[:100], "once upon"])], "doc_id long, text string")
    model = brown.fit(spark, docs)
    assert len(model.vocabulary.words) == 60_000


def test_words_have_their_own_counts_and_unseen_ones_a_share(spark):
    docs = spark.createDataFrame([(1, "aaa bbb ccc " * 5 + "ddd eee eee fff fff fff fff 12a"), (2, None)], "doc_id long, text string")
    model = brown.fit(spark, docs, min_share=5 / 23)
    v = model.vocabulary
    s, _ = v.symbols(["ddd eee fff zzz 12a 34b aaa"])
    p = np.exp(model.emission[s[1:-1]])
    assert p[:6] == pytest.approx([1 / 8, 2 / 8, 4 / 8, 1 / 8, 1 / 2, 1 / 2])
    assert len(v.words) == 3 and len(set(s.tolist())) == 8  # a word never seen isn't one seen once
    outside = brown.perplexity(spark, spark.createDataFrame([(1, "aaa fff"), (2, "aaa zzz")], "doc_id long, text string"), model).collect()
    assert outside[0].log_prob - outside[1].log_prob == pytest.approx(np.log(4))


def test_own_texts_score_as_by_the_whole_model(spark, odd_documents):
    own = {(r.doc_id, r.n_tokens): r.log_prob for r in brown.perplexity(spark, odd_documents).collect()}
    whole = {(r.doc_id, r.n_tokens): r.log_prob for r in brown.perplexity(spark, odd_documents, brown.fit(spark, odd_documents)).collect()}
    assert own.keys() == whole.keys() and all(own[k] == pytest.approx(whole[k]) for k in own)


def test_clustering_goes_on_until_no_move_gains(spark):
    """The rounds needed are more than any small cap, and a round from the result gains less than the tolerance."""
    r = np.random.default_rng(0)
    kind, words = r.integers(0, 40, 600), 600
    follows = r.permutation(40)
    n: dict[tuple[int, int], int] = {}
    a = 0
    for _ in range(30_000):
        b = int(r.choice(np.flatnonzero(kind == follows[kind[a]]))) if r.random() < 0.8 else int(r.integers(words))
        n[a, b] = n.get((a, b), 0) + 1
        a = b
    bigrams = spark.createDataFrame([(a, b, c) for (a, b), c in n.items()], "a int, b int, n long").coalesce(2)
    classes, table, score = brown.cluster(Scratch(spark, "test"), bigrams, words)
    assert len(score) > 9 and score == sorted(score)
    assert score[-1] - score[-2] < 1e-3 * (score[-1] - score[0])


def test_bigrams_that_rounds_read_are_small_and_whole(spark):
    """Every round reads them all: some 6 bytes an entry, whatever the counts, and tables and moves as from the whole matrix."""
    r = np.random.default_rng(3)
    words, hot, k = 300, 20, brown.CLASSES + brown.RARE + 1
    n = np.where(r.random((words + brown.RARE + 1,) * 2) < 0.3, r.choice([1, 1, 1, 1, 2, 3, 254, 255, 256, 10**6], (words + brown.RARE + 1,) * 2, p=[0.18] * 5 + [0.04, 0.02, 0.02, 0.01, 0.01]), 0)
    n[40:60, :words], n[60:80] = 0, 0  # words that nothing clustered follows, and that nothing follows
    bigrams = spark.createDataFrame([(int(a), int(b), int(n[a, b])) for a, b in np.argwhere(n)], "a int, b int, n long").coalesce(2)
    scratch = Scratch(spark, "test")
    both = scratch.table(brown.packed(bigrams.mapInArrow(brown._given_bigrams(words, 4, hot), brown._CHUNK), 4), "both")
    assert sum(len(x) for row in both.collect() for x in row) < 8 * (np.count_nonzero(n) + np.count_nonzero(n[:, :words]))
    classes = np.concatenate([r.integers(0, brown.CLASSES, words), np.arange(brown.CLASSES, k)]).astype(np.int16)
    of = np.eye(k)[classes]
    e = brown._Exchange(spark, both, classes, words, hot)
    assert (e.table == of.T @ n @ of).all()
    only = r.random(len(classes)) < 0.5
    for marked in (None, only):
        want = {}
        for w in range(words) if marked is None else np.flatnonzero(only[:words]):
            left, right = n[:, w] @ of, n[w] @ of
            left[classes[w]] -= n[w, w]
            right[classes[w]] -= n[w, w]
            gain = brown.move_gains(e.table, int(classes[w]), left, right, n[w, w], brown.CLASSES)
            if gain.max() > 1e-6:
                want[int(w)] = gain.max()
        got = {int(x.w): x.gain for x in e.moves(0, words, only=marked).itertuples()}
        assert got == pytest.approx(want) and len(want) > 50


def test_rounds_read_the_bigrams_without_the_jvm(spark, tmp_path):
    """Tasks of a round take a bounded number of files each, read them in Python, and find what they find through Spark, in a folder of any name."""
    r = np.random.default_rng(5)
    words, k = 200, brown.CLASSES + brown.RARE + 1
    n = np.where(r.random((words + brown.RARE + 1,) * 2) < 0.2, r.choice([1, 2, 255, 300], (words + brown.RARE + 1,) * 2), 0)
    bigrams = spark.createDataFrame([(int(a), int(b), int(n[a, b])) for a, b in np.argwhere(n)], "a int, b int, n long").coalesce(2)
    scratch = Scratch(spark, "test")
    scratch.root = f"file://{tmp_path}/a folder, 100% \u00e9"
    both = scratch.table(brown.packed(bigrams.mapInArrow(brown._given_bigrams(words, 150, 0), brown._CHUNK), 150), "both", "none")
    classes = np.concatenate([r.integers(0, brown.CLASSES, words), np.arange(brown.CLASSES, k)]).astype(np.int16)
    e = brown._Exchange(spark, both, classes, words, 0)
    files = len(both.inputFiles())
    assert 0 < e.tasks < files <= e.tasks * brown.AT_MOST
    plan = e.over(brown._PACKED, lambda batches: batches, both.schema.simpleString()[7:-1].replace(":", " "))._jdf.queryExecution().toString()
    assert "parquet" not in plan.lower()
    table, moves = e.table, e.moves(0, words).sort_values("w", ignore_index=True)
    e.tasks = 0  # through Spark
    assert (e.table_of(e.sent) == table).all() and table.sum() == n.sum()
    assert e.moves(0, words).sort_values("w", ignore_index=True).equals(moves) and len(moves) > 50


def test_a_bucket_of_one_word_keeps_its_side():
    for w, other in ((3, 0), (3, 1), (2, 0), (0, 1)):
        chunk = next(brown._chunks(np.array([w]), np.array([other]), np.array([7]), 1, 0))
        (row,) = (x for b in brown._pack([chunk]) for x in brown._unpacked([b]))
        names, after, before = row
        there, none = (after, before) if other else (before, after)
        assert names.tolist() == [w] and [x.tolist() for x in there] == [[1], [0], [7], []] and [x.tolist() for x in none] == [[0], [], [], []]


def test_words_are_those_of_the_pattern_and_have_their_classes():
    texts = ["".join(map(chr, range(0x100))), "".join(map(chr, range(0x250))), "\u00c9t\u00e9_1 \u00aa\u00b2\u00bd\u00b5 A\x1cb\x85c\u00a0d", "\u0130x \u00dfY", "", " \n", None]
    for t in texts:
        words = brown.words_of(t)
        assert words == brown._WORD.findall((t or "").lower())
        assert (brown.keys_of(words) & 7).tolist() == list(map(brown.rare_class, words))
    lengths = ["x" * i for i in range(1, 15)] + ["x1" * i for i in range(1, 8)]
    assert (brown.keys_of(lengths) & 7).tolist() == list(map(brown.rare_class, lengths))


def test_capital_dotted_i_doesnt_move_the_cut(spark):
    passage = prose(30, 7).replace(".", "")
    texts = [f"\u0130stanbul \u0130zmir {passage} and after", f"\u0130stanbul \u0130zmir {passage}", f"\u0130stanbul {passage} \u039f\u0394\u039f\u03a3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.clean_text for r in decontaminate.contaminated(spark, docs, bench).collect()}
    assert got == {0: "\u0130stanbul \u0130zmir and after", 1: "\u0130stanbul \u0130zmir", 2: "\u0130stanbul \u039f\u0394\u039f\u03a3"}
    assert all(len(decontaminate.lower(chr(c))) == 1 for c in range(0x110000))


def test_remainders_in_any_script_stay(spark):
    passage = prose(30, 7).replace(".", "")
    left = ["\u043f\u0440\u0438\u0432\u0435\u0442", "\u4e2d\u6587", "\u00bd", "...", "word"]
    docs = spark.createDataFrame([(i, f"{x} {passage}") for i, x in enumerate(left)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(spark, docs, bench).collect()}
    assert got == {i: x for i, x in enumerate(left) if x != "..."}


def test_toxicity_filter_loses_no_clause():
    stems = toxicity.Stems(["gruml"], ["grumlig"], 0.0)
    texts = ["You are an _idiot_.", "__idiot__ you", "_grumlax_", "gruml's", "you idiot", "a grumlig day", "nothing here", "I_D"]
    for t in texts:
        found = toxicity.clause_scores(t, stems)
        assert toxicity.document_score(t, stems) == (sum(s for _, s in found), found)
    assert all(toxicity.document_score(t, stems)[0] > 0 for t in texts[:5])


def within_limit(fps: np.ndarray) -> list[int]:
    """For each row the first that pairs within the limit connect it to, by all pairs."""
    bits = np.unpackbits(fps, axis=1).astype(np.int32)
    near = bits.sum(1)[:, None] + bits.sum(1)[None, :] - 2 * bits @ bits.T <= simhash.MAX_DISTANCE
    label = np.arange(len(fps))
    while (least := np.where(near, label[None, :], len(fps)).min(axis=1)).tolist() != label.tolist():
        label = least
    return label.tolist()


def test_groups_near_different_pivots_keep_their_one_link(spark):
    """Blocks of two tight groups 200 bits apart that a single pair connects, or, in every third, that none does."""
    r = np.random.default_rng(1)
    bits, rows = [], []
    for block in range(12):
        base = r.integers(0, 2, simhash.BITS)
        apart = r.permutation(simhash.BITS)
        for member in range(40):
            flipped = base.copy()
            side = member % 2
            moved = apart[: 200 * side] if member > 1 or block % 3 == 0 else apart[:160] if side else apart[:40]
            flipped[moved] ^= 1
            flipped[r.choice(apart[200:], 3 * (member > 1), replace=False)] ^= 1
            bits.append(flipped)
            rows.append((block, len(rows)))
    fps = np.packbits(np.array(bits), axis=1)
    members = spark.createDataFrame([(key, i, fps[i].tobytes()) for key, i in rows], "key long, id long, fp binary")
    scratch = Scratch(spark, "test")
    roots = simhash.connected_components(simhash._hot_edges(members, scratch, 15, 2), scratch).collect()
    got = {x.id: x.root for x in roots}
    assert [got.get(i, i) for i in range(len(rows))] == within_limit(fps)
    assert len(set(within_limit(fps))) == 16


def test_groups_dont_depend_on_what_a_task_holds(spark, monkeypatch):
    """Tight groups 200 bits apart, connected by one pair that meets in one block only, which a task holds or doesn't."""
    r = np.random.default_rng(2)
    places = np.arange(simhash.BITS).reshape(simhash.BLOCKS, simhash.WIDTH)[1:, simhash.PROBES :]  # no pair differs in the first block or in uncertain bits
    rows = []
    for family in range(5):
        base = r.integers(0, 2, simhash.BITS)
        apart = r.permuted(places, axis=1).T.ravel()  # a bit of each block, then another of each
        for member in range(40):
            flipped = base.copy()
            flipped[apart[: 200 * (member % 2)] if member > 1 else apart[:160] if member else apart[:40]] ^= 1
            flipped[r.choice(apart[200:], 3 * (member > 1), replace=False)] ^= 1
            rows.append((len(rows), (len(rows), family), np.packbits(flipped).tobytes(), bytes([0, 1, 2] * simhash.BLOCKS)))
    made = spark.createDataFrame(rows, f"doc_id long, rid {ROW_KEY}, fp binary, weak binary").coalesce(1)
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs: docs)
    by_hot = [{x.doc_id: x.keep_id for x in simhash.near_duplicates(spark, made, hot, pivots).collect()} for hot, pivots in ((simhash.HOT, simhash.PIVOTS), (15, 2))]
    assert by_hot == [{i: i - i % 40 for i in range(len(rows))}] * 2
