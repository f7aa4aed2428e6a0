import random

import pytest
from pyspark.sql import types as T

CLASHING = ["doc", "text_hash", "row", "cut", "part", "key", "kind", "hi", "lo", "fp", "ids", "quality", "n_chars"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in CLASHING]])


def small_corpus(seed: int = 5) -> list[tuple[int, str]]:
    """Invented prose with exact and near copies, shared lines and passages, and short texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) for _ in range(n))

    shared = [prose(12) for _ in range(4)]
    passage = prose(70)
    docs = []
    for i in range(60):
        lines = [prose(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        for line in shared:
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), rng.choice(["", "  "]) + line.upper() + "\t")
        if rng.random() < 0.2:
            lines.append(prose(3) + " " + passage + " " + prose(3))
        docs.append("\n".join(lines))
    for i in range(12):
        docs.append(docs[i % 5])
        base = docs[10 + i].split(" ")
        base[len(base) // 2] = "changed"
        docs.append(" ".join(base))
    docs += ["", " ", "x", "a b", "\n\n", passage]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(7 * k, docs[i]) for k, i in enumerate(order)]


@pytest.fixture(scope="session")
def corpus():
    return small_corpus()


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3)


EDGE_ROWS = [(None, "a text without an id, long enough to be a line of its own"), (1, None), (2, ""), (3, " \t "),
             (4, "same row"), (4, "same row"), (5, "one id"), (5, "two texts " * 30), (6, "w" * 60_000),
             (7, "long line again and again\n" * 2_000), (8, "long line again and again\nend"),
             (9, "long line again and again"), (10, "two texts " * 30)]


@pytest.fixture(scope="session")
def edge_df(spark):
    rows = [(i, t, *["other"] * len(CLASHING)) for i, t in EDGE_ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


@pytest.fixture(scope="session")
def empty_df(spark):
    return spark.createDataFrame([], SCHEMA)
