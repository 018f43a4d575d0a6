import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string, n int, sketch array<int>, comp int, label int, size long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text[, source[, lang]]) rows, with more columns whose names operators use inside."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "k", 0, [1], 9, 9, 9) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.repartition(parts, "doc_id") if rows else df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and blank texts, ties, repeated rows and ids, long texts."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, "one two three four five six", None),
        (6, "ünï ☃ 😀 naïve x\x1cy z", "s", None), (7, "a " * 3000), (8, "x" * 20000), (9, "line\nline\nline\nline\nline"), (9, "other text for the same id"),
    ]


@pytest.fixture(scope="session")
def prose():
    """Documents of random words: (id, text) with copies, near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    text = lambda: "\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 9)))
    rows = [text() for _ in range(120)]
    passage = "\n".join(line(14) for _ in range(4))
    rows += [rows[i] for i in range(0, 40, 4)]  # copies
    for i in range(30):  # near copies, some nearer than others
        words = re.split("( |\n)", rows[i])
        for _ in range(rng.randint(1, 3)):
            words[2 * rng.randrange(len(words) // 2 + 1)] = rng.choice(vocabulary)
        rows.append("".join(words))
    rows += [f"{text()}\n{passage}\n{text()}" for _ in range(12)]
    base = line(160).split()
    for _ in range(90):  # one large group of near copies, not all of them linked with each other
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    return list(enumerate(rows))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
