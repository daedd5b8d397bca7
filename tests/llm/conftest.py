import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, h long, fp string, score string, size string, tokens string, part string, c0 string"


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, len(text or ""), 7, "k", 1, "f", "s", "z", "t", "p", "c")


@pytest.fixture(scope="session")
def prose():
    """Word salad of a fixed seed."""
    rnd = random.Random(5)
    vocabulary = ["the", "of", "and", "a", "in", "is"] + ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(900)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def edges(spark, prose):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and names that clash with inner ones."""
    line = "this line is shared by many of the documents of the table"
    rows = [row(1, prose(60, 1)), row(1, prose(60, 1)), row(2, None), row(3, ""), row(None, prose(40, 2)), row(None, None, None, None),
            row(4, " \n\t "), row(5, prose(60_000, 3)), row(6, "naïve 中文 \U0001f600 </turn> ### \\ end\r\n\x85", None), row(7, prose(60, 1), "b")]
    rows += [row(10 + i, f"{line}\n{prose(30, 50 + i)}\n  {line.upper()} ", "b") for i in range(6)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
