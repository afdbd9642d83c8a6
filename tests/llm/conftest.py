from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node int, digest string, row int, key int"
LONG = " ".join(f"palabra{i % 977} tiene sentido" for i in range(12_000))


def row(i, text, lang="en"):
    return (i, text, lang, "src", len(text or ""), "x", 1, "d", 2, 3)


ODD = [
    row(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    row(2, "alpha  beta\ngamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    row(3, None),
    row(4, ""),
    row(5, " \t\n"),
    row(6, LONG, "es"),
    row(7, LONG + " fin", None),
    row(8, "one", None),
    row(8, "one", None),
    row(None, "no id here", "en"),
    row(None, "no id here", "en"),
    row(-5, "123 456 !!! ###", "en"),
    row(9, "token = abcdefgh12345678 and 漢字 😀 é x y \x1c\x85"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
