import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk long, node long, h long, w string, text_key string"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 8))) for _ in range(n))


def documents() -> list[tuple]:
    """Nulls, empty and white texts, a very long one, copies, near copies, shared passages, repeated rows and ties."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(2, 50)
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: " \n\t ", 7: "two words", 8: "two words", 9: passage + " " + prose(3, 40),
        10: prose(4, 30) + "\n" + passage, 11: passage + "\n" + passage, 12: prose(5, 9000), 13: "Größe 日本語 a\u0301 naïve\u00a0x  y\n\nz", 14: "x" * 3000, 15: prose(6, 34), 16: prose(7, 35), 17: prose(7, 35),
    }
    rows = [(i, t) for i, t in texts.items()]
    rows += [(16, texts[16]), (None, prose(8, 60)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, None, None, None if t is None else len(t), "r", 1, 2, 3, "w", "k") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
