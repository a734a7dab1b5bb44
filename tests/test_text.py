import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.errors import MissingModelFile
from corpusloom.functions import bert
from corpusloom.functions.porter import stem
from corpusloom.functions.text import basic_tokens, clamp, clean_text, pad_ideographs, query_words, surrounded, unix_lines, words
from corpusloom.operators import lexical

ROWS = [(1, "The dogs run. A Café by the river!"), (2, "One dog was running; it ran 2 miles."), (3, "Cats sleep, and more cats"), (4, ""), (5, None), (6, "cat dog cat dog"), (7, "naïve relational organization of hopeful generalizations")]


def test_stems():
    for a, b in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "generalizations": "gener", "adjustable": "adjust", "controll": "control", "sky": "sky", "roll": "roll"}.items():
        assert stem(a) == b


def test_words(spark):
    df = spark.createDataFrame([("Ça va, l'été 2?",), (None,)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["ca", "va", "l", "ete", "2"], []]
    assert query_words("Été été X") == ["ete", "x"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a\x00b‍\tc�", "x中y", "don't stop—now!", "a\r\nb")], "a string, b string, c string, d string")
    r = df.select(clean_text(F.col("a")), pad_ideographs(F.col("b")), basic_tokens(F.col("c")), unix_lines(F.col("d")), surrounded(F.col("b"), "|")).first()
    assert list(r) == ["ab\tc", "x 中 y", ["don", "'", "t", "stop", "—", "now", "!"], "a\nb", "|x中y|"]
    assert clamp(7, 0, 5) == 5 and clamp(-1, 0, 5) == 0


def fts(query, ids=False):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(t, tokenize='porter')")
    c.executemany("insert into f(rowid, t) values (?, ?)", ROWS)
    return [(i, round(r, 9)) for i, r in c.execute("select rowid, rank from f where f match ? order by rank, rowid", (query,))]


@pytest.mark.parametrize("asked, match", [("dogs", "all"), ("dog cat", "any"), ("dog cat", "all"), ("running", "all"), ("cafe", "all"), ("nothing", "any"), ("generalization", "all")])
def test_bm25_is_that_of_fts5(spark, asked, match):
    rows = spark.createDataFrame(ROWS, "id long, t string")
    found = [(r.id, round(r["rank"], 9)) for r in lexical.search(rows, asked, ["t"], match).collect()]
    assert found == fts((" OR " if match == "any" else " AND ").join(asked.split()))
    index = lexical.postings(rows, ["t"])
    lengths = rows.select("id", F.size(words(F.col("t"))).cast("double").alias("len"))
    again = [(r.id, round(r["rank"], 9)) for r in lexical.search_postings(index, lengths, asked, match).collect()]
    assert again == found


def test_no_tokens_no_hits(spark):
    rows = spark.createDataFrame(ROWS, "id long, t string")
    assert lexical.search(rows, " ?! ", ["t"]).count() == 0
    assert lexical.search(rows, "dog", ["t"], limit=0).count() == 0


def test_ids_are_text_where_asked(spark):
    rows = spark.createDataFrame([(2, "alpha"), (3, "beta 2")], "id long, t string")
    assert [r.id for r in lexical.search(rows, "2", ["t"], stemmed=False, index_ids=["id"]).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in lexical.search(rows, "2", ["t"], stemmed=False).collect()] == [3]


VOCAB = ["[CLS]", "[SEP]", "[UNK]", "un", "##aff", "##able", "hello", "!", "e", "##t", "##e", ""]


def test_word_pieces():
    v = bert.load_vocabulary(list(VOCAB))
    assert bert.word_pieces("unaffable", v) == ["un", "##aff", "##able"]
    assert bert.word_pieces("unknown", v) == ["[UNK]"]
    assert bert.word_pieces("hello", v, 3) == ["[UNK]"]
    with pytest.raises(MissingModelFile):
        bert.load_vocabulary(["a"])


@given(st.text("unafble", max_size=12))
def test_pieces_join_to_the_word(word):
    v = bert.load_vocabulary(list(VOCAB))
    p = bert.word_pieces(word, v)
    assert p == ["[UNK]"] or "".join(x.removeprefix("##") for x in p) == word


def test_encode(spark):
    v = bert.load_vocabulary(list(VOCAB))
    df = spark.createDataFrame([("Hello! Été unaffable",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(bert.encode(F.col("t"), v)).collect()]
    assert got[0].input_ids == [0, 6, 7, 8, 9, 10, 3, 4, 5, 1] and got[0].attention_mask == [1] * 10
    assert got[1].input_ids == got[2].input_ids == [0, 1]
    assert df.select(bert.encode(F.col("t"), v, max_length=4)).first()[0].input_ids == [0, 6, 7, 1]


def test_model_folder(tmp_path):
    with pytest.raises(MissingModelFile):
        bert.load_folder(str(tmp_path))
    (tmp_path / "vocab.txt").write_text("\n".join(VOCAB))
    (tmp_path / "config.json").write_text('{"dimensions": 8, "maximumInputCharactersPerWord": 50, "cleanText": true, "handleChineseCharacters": true, "stripAccents": null, "lowercase": null, "searchPrefix": "query: "}')
    v, c = bert.load_folder(str(tmp_path))
    assert v["hello"] == 6 and not c.strips and bert.query_text("x", c) == "query: x"
