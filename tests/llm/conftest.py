import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id bigint, text string, lang string, source string, n_chars bigint"


#: Columns that clash with names of results and helpers.
CLASH = "doc_id bigint, text string, key string, score double, block int, root string, links bigint, rule string, row bigint, piece int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and clashing columns."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    texts = [(1, None), (2, ""), (3, "   "), (4, "!!! ..."), (5, long), (6, "one"), (6, "one"), (None, "no id here at all"), (None, None), (7, "É " * 5), (8, "\u0000​\U0001f600")]
    return spark.createDataFrame([(i, t, "k", 0.1, 1, "r", 2, "x", 3, 4) for i, t in texts], CLASH)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASH)
