import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def docs(spark):
    """A function from (doc_id, text) pairs to a documents table with a column whose name clashes with inner ones."""

    def make(rows):
        data = [(i, t, "en", f"s{n % 3}", len(t) if t is not None else None, n) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, key long")

    return make
