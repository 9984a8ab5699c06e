import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts or (id, text) pairs, with clashing extra columns."""
    def make(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return frame.selectExpr("*", "'x' AS lang", "'s' AS source", "1L AS n_chars",
                                "'clash' AS _id", "'clash' AS _mine", "'clash' AS _key")
    return make
