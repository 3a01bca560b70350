import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string, vector string, rank int, sketch string"


def prose(n: int, seed: int, letters: str = "aeiourstlnmd") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, and columns named like the operators' own."""
    long = prose(30_000, 1)
    texts = [None, "", "   \n\n ", "one", "one two three", long, long + " end", prose(80, 2), prose(80, 2), prose(80, 3), "é ü ñ 日本語 😀 é", "12345 67890"]
    rows = [(i, t, None if i % 4 == 0 else "en", f"s{i % 2}", None, "d", "k", "v", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[7], (None, prose(80, 2), "en", None, 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
