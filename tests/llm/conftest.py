"""Documents with every awkward case: nulls, empty and long texts, repeats, and columns whose names clash with the operators' own."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, digest string, kept boolean, n_words long, bucket long, "
    "component_id long, score double, language string, ids array<int>"
)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows(texts):
    """(doc_id, text) pairs as full rows, the clashing columns filled with rubbish."""
    return [(i, t, "en", f"src{(i or 0) % 3}", 1, 7, "x", False, -1, 9, -5, 2.0, "zz", [1]) for i, t in texts]


@pytest.fixture(scope="session")
def awkward():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one two"), (9, prose(2, 5000)),
        (10, base.upper()), (11, "Äpfel Öl ÜBER straße"), (11, "Äpfel Öl ÜBER straße"), (None, "no id here"), (12, "x" * 3000), (13, "a\x00b\u2028c"), (14, "😀 emoji 😀"),
    ]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(rows(awkward), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
