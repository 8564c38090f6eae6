import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()),
    StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()),
    # names that the operators use inside
    StructField("key", StringType()), StructField("n", LongType()),
    StructField("rank", LongType()), StructField("fp", StringType())])

WORDS = ("stone river cloud amber lantern copper willow harbor meadow falcon granite velvet "
         "thunder orchard silver canyon ember timber glacier prairie").split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    out = []
    while len(out) < n:
        out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(4, 9))) + ".")
    return "\n".join(out[:n])


ODD = [None, "", " \n\t ", "one", "two words", "!!! ### 123", "née Ünïcode 中文 😀 ñandú",
       "<|endoftext|> and <|end", "x" * 5000, "ab" * 3000, "same line\n" * 300,
       "the first second third\x0bfourth\x1cfifth"]


def odd_rows() -> list[tuple]:
    """Nulls everywhere, odd texts, repeated rows and a very long text."""
    rows = [(k, t, "en", "host", len(t or ""), "k", 1, 2, "f") for k, t in enumerate(ODD)]
    rows += [(100 + k, prose(k, 12), "en", "host", 5, "k", 1, 2, "f") for k in range(6)]
    rows += [(200, prose(0, 12), None, None, None, None, None, None, None)]
    rows += [(100, prose(0, 12), "en", "host", 5, "k", 1, 2, "f")] * 2
    rows += [(None, prose(3, 12), None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None),
             (None, prose(77, 5), None, "host", 3, None, None, None, None)]
    rows += [(300, prose(50, 6000), "de", "host", 9, "k", 1, 2, "f")]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=SCHEMA):
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    return frame(odd_rows()).repartition(3)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
