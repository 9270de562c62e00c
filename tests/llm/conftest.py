import random

import pytest

WORDS = "the of and to in is it that for on with as at by from or an be this was river stone cloud amber fjord lantern meadow orchid quartz saddle thistle umbrella velvet walnut yonder zephyr".split()
#: Names that operators use themselves: they must come through untouched.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, fp long, keep_id string, kept string, ids string, part int, key string, toxic string, norm string, raws string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", str(r.randrange(50))]) for _ in range(n))


def full(doc_id, text):
    return (doc_id, text, "en", "s", None, "r", "d", 7, "k", "x", "i", 1, "key", "t", "n", "w")


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empties, a very long text, repeated rows, ties, and columns with names that operators use."""
    rows = [(1, prose(1, 120)), (2, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (None, prose(2, 60)), (None, None), (5, " \t\n"), (6, prose(3, 30000)), (7, "one"), (8, prose(1, 120) + " end"), (9, "é ü 日本 " * 30)]
    return spark.createDataFrame([full(*r) for r in rows], EXTRA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)
