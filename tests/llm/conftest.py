import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size bigint, kept string, digest string, `odd name` int, sequence_id string, offset string"
)


def prose(seed: int, n: int) -> str:
    """Words that hardly ever repeat in a row, with line ends."""
    draw = random.Random(seed)
    return " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(3000)}" + ("\n" if draw.random() < 0.05 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = prose(1, 30_000)
    near = prose(2, 200).split()
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, "One TWO three four"), (7, long), (8, long),
        (9, " ".join(near)), (10, " ".join([*near[:100], "changed", *near[101:]])), (10, " ".join(near)), (11, "É é"), (11, "É é"),
        (None, "É é"), (None, None), (12, "x y " * 400), (13, prose(3, 60) + "\x1c end"), (14, "\x00 \x85 a\x0bb"),
    ]
    rows = [
        (d, t, "en", [None, "b", "a", "ä"][i % 4], None, 7, "yes", "d", i, "s", None) for i, (d, t) in enumerate(texts)
    ]
    return [*rows, rows[8]]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")
