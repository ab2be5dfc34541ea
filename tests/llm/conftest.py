import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from growthlens.session import checkpoint_dir  # noqa: E402

@pytest.fixture(scope="session", autouse=True)
def folder(spark):
    checkpoint_dir(spark)


@pytest.fixture
def documents(spark):
    """Documents from texts, with columns that clash with results and helpers."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", 7, "x") for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, score string")

    return make
