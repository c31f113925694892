import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame([(*row, *[None] * (5 - len(row))) for row in rows] if schema == DOCS else rows, schema)

    return make
