import os

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def shipped(spark):
    from sitelens.session import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return SF


@pytest.fixture(scope="session")
def odd_documents(shipped):
    """Nulls, empties, ties, repeated rows, a very long text and columns with clashing names."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [(1, "the same text of some words here", "s"), (2, "the same text of some words here", "s"),
            (2, "the same text of some words here", "s"), (3, None, None), (4, "", "s"), (5, "one", "t"),
            (6, long_text, "t"), (7, long_text + " and a little more", "t"), (None, "a text without an id", "s"),
            (8, "line\nline\n\nother\n", None)]
    return shipped.createDataFrame(
        [(i, t, "en", s, len(t or ""), "x", 0, 1.0) for i, t, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, n_dropped string, copy int, toxicity double")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
