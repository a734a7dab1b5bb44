import threading
import time

import pytest
from pyspark.errors import PySparkException

from corpusloom.errors import DocumentNotFound, DuplicateDocument, NoDocuments, NotPositive
from corpusloom.operators.embedding import HashingProvider
from corpusloom.plans.keyed import KeyedExecutor
from corpusloom.plans.store import Store
from corpusloom.schema import anchor
from corpusloom.sources.registry import text_contents
from corpusloom.streaming.ingest import ingest

SONGS = {"Dogs": "Dogs run fast. The dog is running home. A long walk in the park.", "Cats": "Cats purr softly. A cat is no dog at all. They sleep.", "Birds": "Birds sing at dawn. Original songs are sung.", "Fish": "Fish swim in the sea. They say nothing."}


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), HashingProvider(64))
    for i, (title, text) in enumerate(SONGS.items()):
        s.create_document(f"u{i}", title, f"about {title.lower()}", text_contents(text, 30))
    return s


def piece_texts(df):
    return [r.text_content for r in df.collect()]


def test_lifecycle(spark, store):
    assert store.piece_count() == 10 and store.embeddings.count() == 10
    before = {r.id for r in store.pieces.collect()}
    assert before == set(range(1, 11)) and {r.id for r in store.documents.collect()} == {1, 2, 3, 4}
    one = store.read_document(uuid="u0").first()
    assert one.title == "Dogs" and [p.text_content for p in one.pieces] == ["Dogs run fast.", "The dog is running home.", "A long walk in the park."]
    # reads
    assert piece_texts(store.read_piece("u0", 1)) == ["The dog is running home."] and store.read_piece("u0", 9).count() == 0
    assert piece_texts(store.read_range("Dogs", 0, 2)) == piece_texts(store.read_piece_context("Dogs", 1, 1, 1)) == ["Dogs run fast.", "The dog is running home."]
    assert {r.uuid for r in store.read_documents(["u1", "u3", "none"]).collect()} == {"u1", "u3"} and store.read_documents([]).count() == 0
    assert store.read_document(title="None").count() == 0
    # update: the id stays, pieces are new
    store.update_document("u0", text_contents("Only wolves now.", 30), description="about wolves")
    one = store.read_document(uuid="u0").first()
    assert (one.id, one.title, one.description, [p.text_content for p in one.pieces]) == (1, "Dogs", "about wolves", ["Only wolves now."])
    assert not {p.id for p in one.pieces} & before and store.embeddings.count() == store.piece_count() == 8
    with pytest.raises(DocumentNotFound):
        store.update_document("none", [])
    with pytest.raises(DuplicateDocument):
        store.update_document("u0", [], title="Cats")
    # delete: with pieces and vectors; again, or what isn't there, is nothing
    store.delete_document("u1")
    store.delete_document("u1")
    store.delete_document("none")
    assert store.read_document(uuid="u1").count() == 0 and store.pieces.filter("parent_id = 2").count() == store.embeddings.filter("parent_id = 2").count() == 0
    # a document made again has new ids
    store.create_document("u1", "Cats", "", text_contents("New cats.", 30))
    assert store.read_document(uuid="u1").first().id == 5
    with pytest.raises(DuplicateDocument):
        store.create_document("u9", "Cats", "", [])
    with pytest.raises(DuplicateDocument):
        store.create_document("u1", "Other", "", [])
    # opening again, rewriting, new vectors
    want = sorted(map(str, store.read_documents().collect()))
    again = Store(spark, store.path, HashingProvider(32))
    assert sorted(map(str, again.read_documents().collect())) == want
    again.re_embed()
    assert {len(r.embedding) for r in again.embeddings.collect()} == {32} and again.embeddings.count() == again.piece_count()
    again.compact()
    again.vacuum()
    assert sorted(map(str, again.read_documents().collect())) == want
    again.create_document("u8", "Later", "", text_contents("Later text.", 30))
    assert again.read_document(uuid="u8").first().id == 6


def test_search(store):
    for ranking in ("reciprocal", "relative"):
        rows = store.search("dog", 2, 0.1, ranking).collect()
        assert rows[0].title == "Dogs" and rows[0].document_rank == 0 and {r.title for r in rows} == {"Dogs", "Cats"}
        assert [r.piece_rank for r in rows if r.title == "Dogs"] == list(range(sum(r.title == "Dogs" for r in rows)))
    only_title = store.search("about fish", 4, 0.99).collect()
    assert [(r.title, r.piece_id) for r in only_title] == [("Fish", None)]
    e = store.search("dog", 4, 0.1, explain=True).collect()
    assert e[0].n_lexical == 3 and e[0].n_title == 1 and any(r.similarity for r in e) and any(r.lexical_score for r in e)
    assert store.search("???", 4, 0.1).count() == 0
    with pytest.raises(NotPositive):
        store.search("dog", 0)
    within = store.search_within("u2", "Original", 5, 0.1).collect()
    assert "Original" in within[0].text_content and [r.piece_rank for r in within] == list(range(len(within)))
    assert len(store.search_within("u0", "dog run walk", 2, 0.0).collect()) == 2
    with pytest.raises(NoDocuments):
        store.search_within("none", "x")


def test_empty_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), HashingProvider(8))
    assert s.documents.count() == s.piece_count() == s.read_documents().count() == 0
    with pytest.raises(NoDocuments):
        s.search("x")
    s.create_document("u", "Empty", "", [])
    assert s.read_document(uuid="u").first().pieces == []
    with pytest.raises(NoDocuments):
        s.search_within("u", "x")


def test_places_and_images_come_back(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), HashingProvider(8))
    rows = [
        {"content_type": 0, "text_content": "Hello world", "sequence_index": 3, "document_length": 9, "anchor": anchor("text", char_range=(0, 11))},
        {"content_type": 0, "text_content": "on a page", "sequence_index": 4, "document_length": 9, "anchor": anchor("pdf", page=4, char_range=(5, 20))},
        {"content_type": 1, "text_content": "A caption word", "data_content": b"\x01\x02", "sequence_index": 5, "document_length": 9, "anchor": anchor("pdf", page=7)},
        {"content_type": 0, "text_content": "lines", "sequence_index": 6, "document_length": 9, "anchor": anchor("location", text_range=((1, 2), (3, 4)))},
        {"content_type": 0, "text_content": "tags", "sequence_index": 7, "document_length": 9, "anchor": anchor("selector", selectors=["#a", "p > b"])},
    ]
    s.create_document("u", "T", "", rows)
    got = s.pieces.orderBy("sequence_index").collect()
    assert [r.anchor.asDict(recursive=True) for r in got] == [r["anchor"] for r in rows] and bytes(got[2].data_content) == b"\x01\x02" and [r.sequence_index for r in got] == [3, 4, 5, 6, 7]
    assert s.embeddings.count() == 4
    assert [r.piece_id for r in s.search("caption", 3, 0.9).collect()] == [3]
    s.update_document("u", [{"content_type": 1, "data_content": b"x", "sequence_index": 0, "document_length": 1}])
    assert s.embeddings.count() == 0 and s.piece_count() == 1


def test_what_fails_leaves_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), HashingProvider(8))
    for bad in ({"content_type": 0}, {"content_type": 1}, {"content_type": 7, "text_content": "x"}):
        with pytest.raises(PySparkException):
            s.create_document("u", "T", "", [bad])
    assert s.documents.count() == s.piece_count() == 0
    s.create_document("u", "T", "", text_contents("Fine.", 9))
    assert s.documents.first().id == 1


def test_legacy(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), HashingProvider(8))
    docs = spark.createDataFrame([(4, "u4", "Old", "d")], "id long, uuid string, title string, description string")
    pieces = spark.createDataFrame([(9, 0, "Old words", None, b"\0", 4)], "id long, contentType int, textContent string, dataContent binary, embeddings binary, parentID long")
    s.load_legacy(docs, pieces)
    p = s.pieces.first()
    assert (p.id, p.parent_id, p.sequence_index, p.document_length, p.anchor.kind, p.anchor.char_range.upper) == (9, 4, 0, 1, "text", 9) and s.embeddings.count() == 1
    s.update_document("u4", text_contents("New words.", 30))
    assert s.pieces.first().id == 10
    s.delete_document("u4")
    assert s.documents.count() == 0


def test_many_at_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), HashingProvider(8))
    docs = spark.createDataFrame([(f"u{i:03d}", f"t{i}", "") for i in range(200)], "uuid string, title string, description string")
    contents = spark.createDataFrame([(f"u{i:03d}", 0, f"text {i} {j}", None, j, 3, None) for i in range(200) for j in range(3)], "uuid string, content_type int, text_content string, data_content binary, sequence_index int, document_length int, anchor string").drop("anchor")
    from pyspark.sql import functions as F

    from corpusloom.schema import text_anchor

    s.create_documents(docs, contents.withColumn("anchor", text_anchor(F.lit(0), F.lit(1))))
    assert sorted(r.id for r in s.documents.collect()) == list(range(1, 201)) and sorted(r.id for r in s.pieces.collect()) == list(range(1, 601))
    s.delete_documents([f"u{i:03d}" for i in range(100)])
    assert s.documents.count() == 100 and s.piece_count() == 300


# one after the other for a key


def test_tasks_of_a_key_run_in_order_and_others_beside_them():
    e = KeyedExecutor()
    seen, running, most = [], set(), [0]
    lock = threading.Lock()

    def task(key, i):
        with lock:
            assert key not in running
            running.add(key)
            most[0] = max(most[0], len(running))
        time.sleep(0.005)
        with lock:
            seen.append((key, i))
            running.remove(key)
        return i

    futures = [e.submit(k, lambda k=k, i=i: task(k, i)) for i in range(15) for k in "abc"]
    assert [f.result() for f in futures] == [i for i in range(15) for _ in "abc"]
    for k in "abc":
        assert [i for x, i in seen if x == k] == list(range(15))
    assert most[0] > 1
    for _ in range(100):
        if not e.keys:
            break
        time.sleep(0.01)
    assert not e.keys
    e.close()


def test_a_failure_does_not_hold_up_the_next():
    e = KeyedExecutor()
    bad, good = e.submit("k", lambda: 1 / 0), e.submit("k", lambda: "fine")
    with pytest.raises(ZeroDivisionError):
        bad.result()
    assert good.result() == "fine" and e.run("k", lambda: 3) == 3
    e.close()


def test_files_are_taken_in_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = Store(spark, str(tmp_path / "s"), HashingProvider(8))
    for n in range(2):
        (tmp_path / "in" / f"{n}.txt").write_text(f"File number {n}. It has two sentences.")
        ingest(spark, str(tmp_path / "in"), s, str(tmp_path / "c")).awaitTermination()
        assert s.documents.count() == n + 1
    assert s.search("number", 5, 0.9).count() == 2
