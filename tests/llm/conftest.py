import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _simhash_key string, key long, x string, id int, _quality_n int, _pii_text string, _decon_text string, g string"


def prose(n: int, seed: int = 0) -> str:
    import random

    r = random.Random(seed)
    syllables = "the an er tion on re th in ing ble st ou ha nd wh ed sh ly ment ra do la mi so".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + ("." if r.random() < 0.08 else "") for _ in range(n))


def rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns named like helpers."""
    more = ("a", 1, "b", 2, 3, "c", "d", "e")
    nothing = (None,) * len(more)
    long = prose(60_000, 5)
    out = [
        (1, prose(200, 1), "en", "s1", 1, *more), (1, prose(200, 1), "en", "s1", 1, *more), (2, prose(200, 1), "en", "s1", 1, *more), (3, prose(200, 1), None, None, None, *nothing),
        (None, prose(150, 2), "en", None, 5, *more), (None, prose(150, 2), None, "s1", 5, *nothing), (4, None, "en", "s1", None, *more), (5, "", "en", "s2", 0, *more), (6, " \n\t ", None, "s1", 4, *more),
        (7, long, "de", "s2", len(long), *more), (8, "word " * 3000, "de", "s2", 1, *more), (9, "x" * 300_000, "fr", "s3", 1, *nothing), (10, "single", "fr", "s3", 6, *more), (10, "single", "fr", "s3", 6, *more),
        (11, "\x00퟿ ​ é 中文 😀", "es", "s3", 9, *more), (None, None, None, None, None, *nothing),
    ]
    return out + [(100 + i, prose(80 + i, 50 + i), "en", "s1", 1, *more) for i in range(25)]


@pytest.fixture(scope="session")
def odd_documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def benchmark_rows(spark):
    return spark.createDataFrame([(1, prose(40, 50)), (1, prose(40, 50)), (2, None), (3, ""), (None, prose(12, 999)), (4, "two words")], "item_id long, text string")


@pytest.fixture(scope="session")
def odd_folder(tmp_path_factory, odd_documents, benchmark_rows, spark):
    folder = tmp_path_factory.mktemp("odd")
    odd_documents.write.parquet(f"{folder}/documents.parquet")
    benchmark_rows.write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, None, 1), (2, None, 1), (100, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory, no_documents, benchmark_rows, spark):
    folder = tmp_path_factory.mktemp("empty")
    no_documents.write.parquet(f"{folder}/documents.parquet")
    benchmark_rows.limit(0).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)
