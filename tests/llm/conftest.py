import pytest

from wayfare.llm.common import small_batches

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (None, "a row without an id, but with words enough"), (9_000_001, None), (9_000_002, ""), (9_000_003, " \n\t "),
    (9_000_004, "one"), (9_000_005, "Tie tie tie tie tie tie\nTie tie tie tie tie tie"),
    (9_000_006, "same text twice, one id apart, five words"), (9_000_007, "same text twice, one id apart, five words"),
    (9_000_008, "the very same row comes two times"), (9_000_008, "the very same row comes two times"),
    (9_000_009, "long " * 30_000 + "x" * 50_000 + "\n" + "é1.2.3.4 " * 2_000),
    (9_000_010, "<|endoftext|> It's  ÜBER   <|ENDOFTEXT|> H̱   日本語 🙂 \x1c ▁▁ x\n\n y "),
]
CLASH = "id long, n_words long, words string, key string, sig string, comp string, removed string, empty string, score string, at string, row string, other_id string, leaked_id string, kept0 string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names the operators use inside."""
    small_batches(spark)
    names = CLASH.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * names) for r in ODD], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="session")
def docs(spark, odd):
    """The smallest ``documents`` and the odd rows, ``doc_id`` and ``text`` only."""
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    return plain.unionByName(odd.select("doc_id", "text"))


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(odd):
    """An empty table."""
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")
