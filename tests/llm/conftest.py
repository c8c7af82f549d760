import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta theta iota kappa lambda sigma omega river stone cloud field".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


BASE = prose(1, 120)
NEAR = " ".join(w if i != 60 else "changed" for i, w in enumerate(BASE.split()))
PASSAGE = prose(9, 60)
EDGE = [
    (0, BASE), (1, BASE), (2, NEAR), (3, None), (4, ""), (5, "!!! ??? 123"), (6, "Größe Éa 😀 naïve " * 9000), (7, 'x token = "abcdef0123456789abcdef" released under the MIT License. ' + prose(2, 40)),
    (7, 'x token = "abcdef0123456789abcdef" released under the MIT License. ' + prose(2, 40)), (None, prose(3, 50)), (8, "a " + PASSAGE + " " + prose(4, 30)), (9, prose(5, 30) + " " + PASSAGE + " end"),
    (10, "z" * 700), (11, "one two three"), (12, "One Two Three"), (100, prose(6, 80)), (200, BASE + " " + prose(7, 10)), (13, "tab\tand\x0bfeed\x1cothers   spaces\n\n\nlines  "),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, n_words long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and more columns with names that operators use."""
    rows = [(d, t, None if i % 5 == 0 else ("en" if i % 2 else "fr"), "s", len(t or ""), None, "k", 1) for i, (d, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge():
    return EDGE
