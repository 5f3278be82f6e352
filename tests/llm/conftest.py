import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


CLASHING = "id long, norm string, prefix string, h long, n long, row string, kept string, text string, lang string, doc_id long, component string, score string, label string, _dropped string"


def odd_rows():
    """NULL ids and texts, empty, blank, very long and repeated texts, beside columns named like internal ones."""
    long = "lorem ipsum dolor sit amet consectetur " * 20_000
    plain = "the quick brown fox jumps over the lazy dog while twelve more words make this text long enough to judge it"
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, plain), (5, plain), (5, plain), (6, plain.upper()), (7, "one two"),
        (8, "one  two"), (9, long), (None, plain), (None, None), (10, "1234 5678 !!!"), (11, "日本語 текст ▁   é🎉"),
        (12, plain), (13, "one"),
    ]
    return [(7, "x", "y", 1, None, "r", "k", t, None if i is None or i % 5 == 0 else "en", i, "c", "s", "l", "d") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), CLASHING).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(4, 1, None), (4, 1, 0), (9, 0, 0), (7, 0, 0), (None, 1, 0), (12, None, 0), (13, 0, 0), (13, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
