import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, th long, key long, row long, cls long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty texts, repeated ids and rows, and columns that operators use inside."""
    def make(rows):
        return spark.createDataFrame([(*r, None, None, 7, 7, 7, 7, 7)[:10] if len(r) == 3 else (*r, *[None] * (5 - len(r)), 7, 7, 7, 7, 7) for r in rows], CLASH)

    return make
