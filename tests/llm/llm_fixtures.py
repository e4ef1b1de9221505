"""Fixtures and small texts for the tests of this folder; test modules import what they use."""

import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, over several partitions."""
    def build(rows):
        full = [(r + (None,) * (4 - len(r)))[:4] + (len(r[1]) if r[1] is not None else None,) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        return df.repartition(3) if rows else df
    return build


PROSE = ("the old mill by the river turned slowly while children ran along the bank and waved to passing boats "
         "until evening came and lamps were lit in every window of the small town below the hill").split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + (r.choice(["", "", "", "s", "ed"])) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i}" for i in range(60_000))
    same = prose(40, 1)
    return [(1, None, None, None), (2, "", "en", "a"), (None, prose(30, 2), "en", "a"), (None, None, None, None), (3, " \n\t \n", "en", "a"),
            (4, long, "en", "b"), (5, same, "en", "a"), (6, same, "fr", "b"), (5, same, "en", "a"), (7, "x" * 50_000, None, "a"),
            (8, "é à ü ① ▁ \U0001F600", "fr", None), (9, "one", "en", "a"), (10, "!!! ### 123", "en", "a"),
            (11, (prose(25, 3) + "\n") * 30, "en", "c"), (12, "a\x00b \x1c c d", "en", "c")]
