import random

from hypothesis import given
from hypothesis import strategies as st

from corpusloom.operators.chunking import chunk_spans, chunks, sentence_chunks, sentences

TEXTS = st.text("ab .!?\n", max_size=200)


def fold(text, context, prefix=0):
    """The packing sentence by sentence, after its definition."""
    room = max(context - prefix, 1)
    overlap = int(room * 0.05)
    done, now, at = [], [], 0
    for s in sentences(text or ""):
        if sum(len(x) for _, x in now) + len(s) > room:
            done.append(now)
            keep, size = [], 0
            for a, x in reversed(now):
                if size + len(x) > overlap:
                    break
                keep.insert(0, (a, x))
                size += len(x)
            now = keep
        now = [*now, (at, s)]
        at += len(s)
    out = []
    for c in [*done, now]:
        joined = "".join(x for _, x in c)
        if joined.strip():
            a = c[0][0] + len(joined) - len(joined.lstrip())
            out.append((a, a + len(joined.strip())))
    return out


@given(TEXTS)
def test_nothing_is_lost(text):
    assert "".join(sentences(text)) == text


@given(TEXTS, st.integers(1, 80), st.integers(0, 90))
def test_spans_are_those_of_the_fold(text, context, prefix):
    assert chunk_spans(text, context, prefix) == fold(text, context, prefix)


def test_whole_text_in_one_chunk():
    t = "One here. Two there. Three."
    assert chunks(t, 1000) == [(t, 0, len(t))]


def test_nothing_gives_nothing():
    assert chunks("", 100) == chunks(None, 100) == chunks(" \n ", 100) == []


def test_blanks_around_are_left_out():
    s = "The one sentence that is here, all by itself."
    [(text, a, b)] = chunks("\n\n\n" + s + "\n\n\n", 60)
    assert text == s and (a, b) == (3, 3 + len(s))


def test_neighbours_overlap_and_order_is_kept():
    t = " ".join(f"Sentence number {i} is here." for i in range(150))
    cut = chunks(t, 600)
    assert all(x[2] > y[1] for x, y in zip(cut, cut[1:])) and [x[1] for x in cut] == sorted(x[1] for x in cut)
    assert all(t[a:b] == c for c, a, b in cut)


def test_a_long_sentence_stays_whole():
    t = "word " * 40 + "end. Next."
    assert chunks(t, 50)[0][0] == ("word " * 40 + "end.")


def test_rows(spark):
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(["a.", "bb", "c!", "dd?", "\n"]) for _ in range(r.randint(0, 80)))) for i in range(40)] + [(100, None), (101, ""), (102, "one\r\ntwo")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    for x in sentence_chunks(df, context_size=30, prefix="p: ", sequence_offset=100).collect():
        got.setdefault(x.doc_id, []).append((x.sequence_index, x.document_length, x.text_content, x.anchor.char_range.lower, x.anchor.char_range.upper, x.anchor.kind))
    for i, t in texts:
        want = chunks((t or "").replace("\r\n", "\n"), 30, "p: ")
        assert sorted(got.get(i, [])) == [(100 + k, len(want), c, a, b, "text") for k, (c, a, b) in enumerate(want)]


def test_anchors_are_made_by_the_caller(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string")
    rows = sentence_chunks(df, context_size=5, anchor_maker=lambda lower, upper: F.struct(lower.alias("from"), (upper - lower).alias("size"))).orderBy("sequence_index").collect()
    assert [tuple(r.anchor) for r in rows] == [(0, 4), (5, 4)]
