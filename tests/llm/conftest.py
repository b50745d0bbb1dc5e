import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, label int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "or", "ti", "re", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, near copies, odd characters."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = {
        1: base, 2: base, 3: near, 4: None, 5: "", 6: "  \n\t ", 7: prose(2, 90), 8: prose(2, 90) + " tail", 9: "one two three", 10: "one two three", 11: "ONE  two\tthree", 12: "é" * 60,
        13: "a" * 400, 14: "x" + "a" * 300, 15: prose(3, 30) + "\n" + prose(4, 20) + "\n\n" + prose(3, 30), 16: prose(4, 20), 17: prose(5, 9000), 18: "🙂 naïve don't I'LL  　 end", 19: "0 1 2 3",
    }
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None, "k", 1, 2) for i, t in texts.items()]
    return [*rows, rows[0], (None, base, "en", None, 3, "k", 1, 2), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 1)) for i in range(1, 20)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
