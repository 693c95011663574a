import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token int, copies string, _part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash."""
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "theta", "iota!", "kappa"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(n))
    base = text(80)
    rows = [(1, None), (2, ""), (3, "   \n\t\n"), (None, "no id at all"), (None, None), (5, "same text here"), (6, "same text here"), (6, "same text here")]
    rows += [(10 + i, base + f" tail{i}") for i in range(6)] + [(20 + i, text(30) + "\nShared Line \n" + text(5)) for i in range(12)]
    rows += [(40, "x" * 70_000), (41, text(12_000)), (42, "日本語のテキスト。" * 50), (43, "one two"), (44, "ONE two"), (45, "<|endoftext|> a<|startoftext|>b")]
    full = [Row(i, t, "en" if i and i % 2 else None, None if i is None or i % 3 == 0 else f"s{i % 5}", len(t) if t is not None else None, 7, "x", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
