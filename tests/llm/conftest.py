import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

VOCAB = [a + b for a in ("ka", "to", "mi", "ren", "sol", "vé", "ß") for b in ("", "n", "ra", "lis", "do")]


def prose(rng, n):
    return "".join(rng.choice(VOCAB) + (".\n" if rng.random() < 0.1 else " ") for _ in range(n)).strip()


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, long, short, empty and null texts."""
    rng = random.Random(4)
    docs = {i: prose(rng, rng.randint(5, 260)) for i in range(60)}
    passage = prose(rng, 60)
    for i in range(60, 80):
        docs[i] = prose(rng, 40) + " " + passage + "\n" + prose(rng, rng.randint(0, 40))
    for i in range(80, 95):
        docs[i] = docs[3]
    base = prose(rng, 150).split(" ")
    for i in range(95, 125):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        docs[i] = " ".join(w)
    docs |= {125: "", 126: None, 127: " \t\n ", 128: "one", 129: "ONE", 130: "a " * 500, 131: "x" * 3000, 132: prose(rng, 6000), 133: "two words", 134: "#$%& " * 60, 135: "12 34 56"}
    docs[136] = docs[132][200:9000]
    return docs


@pytest.fixture(scope="session")
def table(spark, texts):
    """documents, with columns whose names clash with those the operators use inside."""
    rng = random.Random(1)
    rows = [(i, t, "en" if i % 2 else None, None if i % 11 == 0 else f"s{i % 4}", len(t or ""), i * 1.5, "x", rng.random()) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k double, m string, size double").repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, nulls in every column, repeated rows."""
    rows = [(None, None, None, None, None), (None, "some text without id", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
