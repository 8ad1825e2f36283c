import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, score string, key string, id string, set string"

WORDS = "the of and to in over stone river light paper window garden letter silver morning winter table music bread".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "ing", "er", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, long and repeated texts, near copies, and repeated and null ids."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    out = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:10]):
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        out += [(100 + i, " ".join(words)), (200 + i, t.upper()), (300 + i, t + "\n" + prose(rng, 30))]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "One"), (405, "one two"), (406, prose(rng, 20_000)), (407, "é́ ﬁ 漢字 \U0001f600 zz"), (0, base[0]), (None, base[1]), (None, None), (408, "\n".join([base[2], base[2], base[3]]))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts beside columns whose names clash with those that operators use."""
    rows = [(i, t, "src0", "x", "k", "i", "s") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where(F.lit(False))
