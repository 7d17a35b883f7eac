import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows, with extra columns whose names clash with internal ones."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", "'x' AS h", "1 AS n", "2 AS node", "'k' AS keep_id", "3 AS fa", "4 AS variant", "5 AS copse_h") if clash else df

    return make
