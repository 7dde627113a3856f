import pytest

WORDS = [f"w{i * 7919 % 1009}" for i in range(4000)]


def prose(start, n):
    return " ".join(WORDS[start % 3000 :][:n])


#: Texts with nulls, empties, ties, repeats, copies, long words and letters beyond ASCII.
TEXTS = [
    (1, prose(0, 120)), (2, prose(0, 120)), (3, prose(0, 119) + " odd"), (4, None), (5, ""), (6, "   \n\t "), (7, "short text"), (8, "short text"), (9, prose(500, 60)),
    (10, prose(520, 60)), (11, "the " * 300), (12, "ÄÖÜ straße café " * 40), (13, "x" * 3000), (14, prose(900, 2500)), (15, prose(900, 2500) + " end"),
    (None, prose(2000, 50)), (16, "日本語 テキスト " * 30), (17, prose(40, 30) + ". " + prose(2500, 40) + "\n" + prose(2900, 20)),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "src", -1, "clash", 9) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, slab int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def twice(spark):
    """Rows that repeat both id and text."""
    return spark.createDataFrame([(1, prose(0, 80)), (1, prose(0, 80)), (2, prose(1000, 80)), (3, None), (3, None)], "doc_id long, text string")
