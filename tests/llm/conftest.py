import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, text_sha256 string, component_id string, part string, _row int"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies; the extra columns have the names of result and work columns."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(0, 100, 9)]
    texts = [None, None, "", " \n\t", "one two", "One TWO", "one  two", "a", " ".join(base), " ".join(base) + " ", *near, " ".join(words(rng, 30_000)), "1234 !!",
             "él niño está aquí con la casa", "<|endoftext|> İ ǆ ́x", "tie tie tie", "tie tie tie", " ".join(words(rng, 4)), " x y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, " ".join(base)), (4, "one two"), (None, "one two"), (None, None), (60, " ".join(words(rng, 200)))]
    return [(i, t, ["en", "de", None][k % 3], None, None, 0.5, "x", "y", "z", "p", k) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
