import pytest

from ledgerloom import runtime
from ledgerloom.llm import components

# Fewer jobs on small tables: neither changes a result.
components.TURNS, runtime.COLLECT_S = 2, 30.0


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "src", None if t is None else len(t), "x", 1.5, "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, __text string, score double, kept string")

    return make
