import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty and very long texts, one word, no letters, repeats."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(20_000))
    return [None, "", " \n\t ", "One", "12 34 !?", long, long + " end", "same words here", "same words here", "Ünï çödé 漢字 😀 text"]


@pytest.fixture()
def docs_of(spark):
    """Documents with clashing extra columns; the last two rows repeat doc_id and text."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), "a", "b") for i, t in enumerate(texts)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score string"
        return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)

    return make
