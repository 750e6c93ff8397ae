from __future__ import annotations

import pytest

#: Nulls, empties, ties, repeated rows, white space, other scripts, a long run without spaces.
AWKWARD = [
    (1, "one two three four five six"),
    (2, None),
    (3, ""),
    (3, ""),
    (None, "one  two\tthree four five six"),
    (4, "one two three four five six"),
    (5, "ONE Two three four five six"),
    (6, " \n\t "),
    (7, "été œuvre naïve ß 日本語 😀 x"),
    (8, "a" * 3000),
    (9, "word " * 900),
    (10, "short"),
    (None, None),
]
SCHEMA = "doc_id long, text string, kept string, fp long"


@pytest.fixture(scope="session")
def awkward(spark):
    """A documents table of hard cases, with extra columns whose names clash."""
    rows = [(i, t, "x", k) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def corpus(tmp_path, spark):
    """Writes tables as a data folder and returns its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
