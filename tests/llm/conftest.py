import random

import pytest

WORDS = [a + b + c for a in ("th", "on", "er", "an", "re", "st") for b in ("a", "e", "i", "o") for c in ("nd", "ng", "r", "", "ly", "tion")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a DataFrame, also of no rows."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.fixture
def corpus(rng):
    """(doc_id, text) with exact copies, near copies, nulls, empty and very long texts, and shared passages."""
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    passage = prose(rng, 70)
    texts = list(base) + [base[3]] * 5 + [base[4].upper()] + [edited(rng, base[i], k) for i in range(8, 20) for k in (1, 2, 4)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 9)}" for _ in range(5)]
    texts += [None, "", " \n\t", "x", prose(rng, 20_000), "ab " * 3000, "\n\n" + base[5] + "\n" + base[5]]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]
