import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, ids=None):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
