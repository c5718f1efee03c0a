"""Awkward tables that every operator must take: nulls, empty and long texts, ties, repeats."""

import random

import pytest

from pagelore.llm.queries import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    long = prose(1, 30_000)
    passage = prose(2, 80)
    texts = [
        (0, prose(3, 60) + "\n" + passage), (1, prose(4, 20) + " " + passage + " " + prose(5, 10)), (2, None), (3, ""), (4, ""),
        (5, long), (6, long), (7, long + " more"), (8, "one"), (8, "one"), (8, "two words"), (None, passage), (None, passage), (None, None),
        (9, "a\nb\na\nb\na\nb"), (10, "Hé ÉÀ ß x\t\ty\x0bz\r\nEnd "), (11, "A B C D\nA B C D\nx"), (12, passage.upper()), (13, " \n\t "),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


@pytest.fixture(scope="session")
def ready(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def awkward(ready):
    return ready.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(ready):
    return ready.createDataFrame([], DOCS)
