import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, n_words bigint, score double, n_hit bigint, keep_id string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "éa", "zeta.", "eta9", "THETA"]) + str(rng.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts of every odd kind: null, empty, blank, one word, very long, ties, repeats, null ids; columns whose names the operators use."""
    rng = random.Random(3)
    long = words(rng, 30_000)
    base = words(rng, 120)
    line = "A line that is long enough to count as repeated"
    texts = [None, "", "  \n\t ", "one", "two words", base, base, base.upper(), base + " tail", "\n".join([line, base[:60], line + " "]), f"{line.upper()}\nrest", f"x\n{line}", long, long + " end", "mail a.b@c.de +49 (30) 12345678 4111 1111 1111 1111 10.0.0.1", "é" * 500, "a" * 20_000, "\x00\x01 ctl", "under the MIT License. under the mit license"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one"), (3, "one"), (None, base), (None, None), (100, words(rng, 60) + " " + base), (101, base + " " + words(rng, 60)), (2**62, "last")]
    return [(i, t, "en", 7, 0.5, 3, "k") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(frame, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in frame.collect()), key=key) == sorted(rows, key=key)
