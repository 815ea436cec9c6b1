from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts: ids count from 0, other columns are filled in."""

    def make(texts, first: int = 0, extra: str = ""):
        rows = [(first + i, t, "en", "s", len(t or "")) + (("x",) if extra else ()) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS + (f", {extra} string" if extra else ""))

    return make

