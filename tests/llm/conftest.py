import pytest

from tunegauge.llm.tables import share_code

SCHEMA = "doc_id long, text string, lang string, _fp string, row string, shard int, slot string, score string, spans string, part string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and very long texts, repeated rows and ids, and columns named like internal ones."""
    share_code(spark)
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [
        (1, "One two three four five six."), (1, "One two three four five six."), (None, "One two three four five six."), (2, None),
        (3, ""), (4, long), (None, None), (1, "another text under the same id"), (5, " \n\t "), (6, "a" * 200_000), (7, "9" * 50_000),
        (8, "é ñ ü 名 🙂 @ +1 1.2.3.4"),
    ]
    return spark.createDataFrame([(i, t, None, "x", "r", 1, "s", "0", "p", "q") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
