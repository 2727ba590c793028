import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables from texts (doc_id counts up, extra columns that clash with inner names)."""

    def make(texts, langs=None, sources=None, first=0):
        rows = [
            (first + i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None if t is None else len(t), "x", 7, "b")
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, body string, id int, key string"
        )

    return make
