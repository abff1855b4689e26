"""Small tables with every awkward row: nulls, empty and long texts, ties, copies, clashing names."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, block int, kept string"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


def rows():
    base = [
        (1, "the cat sat on the mat and looked at the moon " * 8, "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "de", "b"),
        (5, LONG, "en", "a"),
        (6, "the cat sat on the mat and looked at the moon " * 8, "en", "b"),
        (6, "the cat sat on the mat and looked at the moon " * 8, "en", "b"),
        (None, "der Hund und die Katze gehen nach Hause über die Brücke", "de", "b"),
        (9, "Ünïcode ß 中文 words\n\nwith  double  blanks\x1c and <|endoftext|> marks", "xx", "c"),
        (10, "one", "fr", "c"),
    ]
    return [(*r, None, "clash", 7, "clash") for r in base]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
