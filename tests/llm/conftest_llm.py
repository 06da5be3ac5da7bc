"""Words, and a table of odd rows, for the tests of this folder."""
import re

import pytest

FIXTURE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "a", 10),
    (2, "prefix words here alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho suffix", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \n\t ", "de", None, 6),
    (6, "one", "de", "b", 3),
    (7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "a", 10),
    (8, "same line again and again\n" * 12, "en", "b", 300),
    (9, " ".join(f"w{i % 977}x{i % 13}" for i in range(6000)), "en", "b", 40000),
    (10, " ".join(f"w{i % 977}x{i % 13}" for i in range(6000)), "en", "b", 40000),
    (11, "é" * 500 + " ünï " + "é" * 500, "fr", "c", 1005),
    (11, "é" * 500 + " ünï " + "é" * 500, "fr", "c", 1005),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega", "en", "a", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, home int, kind int, n_words long, block string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 1, 5, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 0, 1), (9, 1, 0), (None, 1, 1), (2, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
