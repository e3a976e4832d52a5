import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names clash with those inside the operators."""

    def make(rows, lang=None):
        return spark.createDataFrame([(i, t, lang(i) if lang else None, "s", None, "x", "y") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, long and repeated texts, null and repeated ids."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "Aé b"), (4, "Aé b"), (None, "Aé b"), (None, "only here"), (7, long), (9, long + "."), (8, "Aé b ")]
