import pytest

#: Nulls in every column, empty and blank texts, repeated rows, a repeated id, ties, letters beyond the basic plane.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of the first text, long enough.", "en", "a", 3),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of the first text, long enough!", "en", "b", 3),
    (2, "another text with the id of the one before", None, "b", None),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, " \n\t \n", "fr", "", 5),
    (6, "one", "en", "a", 3),
    (7, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved. cc by cc by", "en", "c", 9),
    (8, "\U00010400\U0001F600 éàü ß  x y 中文", "de", "\U00010400", 9),
    (8, "\U00010400\U0001F600 éàü ß  x y 中文", "de", "\U00010400", 9),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of the first text, long enough.", None, "a", 3),
    (-5, "word " * 30_000, "en", "a", 150_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_null(spark):
    """With null ids too."""
    return spark.createDataFrame([*ROWS, (None, "a text without an id, but with words", "en", "a", 1), (None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def clashing(df):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "id h pos part first last ahead group label words size key bucket removed fingerprint component_id start end length offset target taken lang_pred score line rank a b".split()
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])
