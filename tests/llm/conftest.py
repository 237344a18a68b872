"""Small tables with every awkward row the operators have to take."""

import random

import pytest

SCHEMA = ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, "
          # columns of the caller's with names that the operators use inside
          "id BIGINT, fp BIGINT, h BIGINT, component STRING, score DOUBLE, digest STRING, chunk INT, "
          "words INT, lines INT, partners INT, n_removed INT, _p INT, row_no INT")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéstrn") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_of(texts):
    return [(i, t, "xx", "s", len(t or ""), 1, 2, 3, "c", 0.5, "d", 4, 5, 6, 7, 8, 9, 10) for i, t in texts]


@pytest.fixture(scope="session")
def messy_texts():
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(6)]
    passage = words(rng, 70)
    long = words(rng, 6000)
    texts = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, base[0]), (4, base[0]), (5, base[0].replace(" ", "\n")),
             (6, base[1] + " " + passage), (7, passage + " " + base[2]), (8, base[3] + " " + passage + " " + base[4]),
             (9, "one"), (10, "one"), (11, "ONE"), (12, "two words"), (13, long), (14, long + " tail"),
             (15, "a\nb\nc"), (16, base[5].upper()), (17, base[5]), (18, None), (19, "emoji \U0001f600 and \u0000 nul"),
             (20, "<|endoftext|> inside  and   runs \n of \t white"), (21, "loop loop " * 40)]
    texts += [(3, base[0]), (9, "one")]             # repeated rows
    texts += [(None, base[2]), (None, None)]        # no doc_id
    texts += [(-7, "negative id " + passage)]
    return texts


@pytest.fixture(scope="session")
def messy(spark, messy_texts):
    return spark.createDataFrame(rows_of(messy_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def id_order(i):
    """Null ids come first."""
    return (i is not None, i or 0)
