import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The given documents, and rows with nulls, odd texts, ties, repeats and clashing names."""
    odd = [(900001, None, None, None, None), (900002, "", "en", "", 0), (900003, "", None, "src0", 0),
           (None, "The quick brown fox", "en", "src1", 3), (900004, "one", "en", "src1", 3),
           (900005, "one two", "xx", "src9", 7), (900006, "One  TWO\tthree\n", "en", "src2", 3),
           (900007, "12345 67890 !!", "en", "src2", 3), (900008, "\u4f60\u597d \U0001f600 z", "zh", "src3", 5),
           (900009, "word " * 60_000, "en", "src0", 300_000), (900010, "x" * 200_000, "en", "src0", 200_000)]
    extra = spark.createDataFrame(odd + [odd[4], odd[4]], DOC)
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clash = {name: F.lit("clash") for name in ("fp", "sha", "point", "row", "file", "kept", "position", "_id", "slot",
                                               "score", "said", "at", "grp", "base", "token")}
    return given.unionByName(extra).withColumns(clash).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return documents.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC)
