"""Every operator and every stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate, packing, token_files
from corpusloom.llm.queries import QUERIES


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def whole_texts(bins, enc):
    """(doc_id, text) of the documents that lie whole in bins, put together again from their pieces."""
    parts = []
    for b in bins:
        at = 0
        for p in b["pieces"]:
            parts.append((p["doc_id"], p["start"], packing.ids_of(b["tokens"])[at : at + p["size"]].tolist()))
            at += p["size"]
    cut = {d for d, start, _ in parts if start}
    out = Counter((d, enc.decode(t)) for d, _, t in parts if d not in cut)
    for d in cut:
        mine = sorted((start, t) for x, start, t in parts if x == d)
        out[d, enc.decode([i for _, t in mine for i in t])] += 1
    return out


@pytest.fixture(scope="module")
def found(spark, odd_folder):
    return {n: [r.asDict() for r in q(spark, odd_folder).collect()] for n, q in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_an_empty_table_gives_an_empty_result(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).count() == 0


def test_one_row_of_result_for_each_row(found, odd_documents):
    n = odd_documents.count()
    for name in ("op2_language_id", "op6_token_files", "op9_lm_scoring"):
        assert len(found[name]) == n


def test_texts_without_words_have_null_scores(found):
    for name, column in (("op2_language_id", "language"), ("op9_lm_scoring", "perplexity")):
        got = {r["doc_id"]: r[column] for r in found[name] if r["doc_id"] is not None}
        assert got[4] is None and got[5] is None and got[6] is None and got[7] is not None and got[9] is not None


def test_repeated_rows_get_the_same_answer(found):
    for name in ("op2_language_id", "op9_lm_scoring"):
        a, b = (tuple(r.values()) for r in found[name] if r["doc_id"] == 1)
        assert a == b


def test_repeats(found):
    spans = {r["doc_id"]: r for r in found["op1_suffix_array_dedup"]}
    assert {1, 2, 3, 8} <= set(spans) and not {4, 5, 6, 10} & set(spans)
    assert spans[1]["n_removable"] == 0 and spans[2]["n_removable"] == 200 == spans[2]["n_repeated"]


def test_packing_holds_every_token_once(found, odd_documents):
    enc = token_files.encoder()
    texts = Counter((r.doc_id, r.text) for r in odd_documents.collect() if r.text and not r.text.isspace())
    assert all(r["fill"] == len(packing.ids_of(r["tokens"])) <= 4096 for r in found["op3_best_fit_packing"])
    assert whole_texts(found["op3_best_fit_packing"], enc) == texts


def test_near_copies_keep_the_least_id(found):
    pairs = {(r["keep_id"], r["doc_id"]) for r in found["op8_simhash_near_dedup"]}
    assert {(1, 2), (1, 3)} <= pairs and not {4, 5, 6} & {x for p in pairs for x in p}


def test_rejected_without_words(found):
    kept = {r["doc_id"] for r in found["op7_quality_rules"]}
    assert not {4, 5, 6} & kept and {100, 110, 120} <= kept


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_documents(spark, odd_documents, odd_folder, name, stage):
    out = stage(spark, odd_documents, odd_folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.simpleString() == odd_documents.schema.simpleString()
        kept, before = ids(out), ids(odd_documents)
        assert all(kept[i] <= before[i] for i in kept)
        more = {r.doc_id: (r["_simhash_key"], r.key, r.x, r.id, r._quality_n, r._pii_text, r._decon_text, r.g) for r in out.collect() if r.doc_id == 105}
        if more:
            assert more[105] == ("a", 1, "b", 2, 3, "c", "d", "e")
    else:
        assert out.count() > 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_no_documents(spark, no_documents, empty_folder, name, stage):
    assert stage(spark, no_documents, empty_folder).count() == 0


def test_near_dedup_stage_keeps_one_of_each_group(spark, odd_documents, odd_folder):
    kept = ids(dict(corpus_pipeline.STAGES)["near_dedup"](spark, odd_documents, odd_folder))
    assert kept[1] == 1 and not kept[2] and not kept[3] and kept[10] == 1 and kept[4] == kept[5] == kept[6] == 1 and all(kept[100 + i] == 1 for i in range(25))


def test_decontamination_stage(spark, odd_documents, odd_folder):
    out = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, odd_documents, odd_folder).collect()}
    before = {r.doc_id: r for r in odd_documents.collect()}
    assert out[100].text != before[100].text and out[100].n_chars == len(out[100].text)
    assert all(out[i].text == before[i].text for i in (1, 4, 5, 6, 7, 110, 120))


def test_pipeline_runs(spark, odd_folder, empty_folder):
    assert corpus_pipeline.run(spark, odd_folder).count() > 0
    assert corpus_pipeline.run(spark, empty_folder).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "benchmark_decontamination", "personal_data", "best_fit_packing"]


def test_bins_of_the_pipeline_hold_the_cleaned_texts(spark):
    """Every bin is decoded: it has all texts of the stage before, no passage of the benchmark and no address."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    docs = docs.cache()
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    bins = [r.asDict(recursive=True) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()]
    docs.unpersist()
    assert whole_texts(bins, token_files.encoder()) == before
    texts = "\n".join(t for _, t in before)
    assert "@mail" not in texts and "[EMAIL]" in texts
    words = [" ".join(decontaminate.tokens(t)) for _, t in before]
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    passages = [" ".join(w[i : i + decontaminate.MIN_SPAN]) for w in items for i in range(len(w) - decontaminate.MIN_SPAN + 1)]
    assert not any(p in t for t in words for p in passages)
