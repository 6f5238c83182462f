"""Small tables for the tests of this folder."""

import random

import pytest

WORDS = "the of and river stone light under house green walking paper seven cloud music never table garden winter north carry".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences of random words: prose(seed, n) has n words."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))

    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))
