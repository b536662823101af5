import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, key string, word string, mix_hash long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents with columns whose names clash with those that operators add."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s[0] if s else "web", len(t or ""), 7.0, 1, "k", "w", 3) for i, t, *s in rows], DOC)

    return make


@pytest.fixture(scope="session")
def small(spark):
    """Rows of a smallest table by id."""

    def read(name, *columns):
        return {r[0]: r[1] if len(columns) == 2 else tuple(r[1:]) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*columns).collect()}

    return read
