import hashlib
import random

import numpy as np
import pytest

from textloom.llm import linededup

from .conftest import same

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    return k if len(k) >= 20 else None


def expected(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(linededup.LOWEST if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = linededup.LOWEST if i is None else i
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "shard_keys": 3, "part_rows": 10}, {"shard_keys": 2}])
def test_random_lines(spark, options):
    rng = random.Random(8)
    pool = [f"  Líne number {i} of the pool {'x' * (i % 9)}\t" for i in range(40)] + ["short", "", "x" * 19, "é" * 20, "é" * 10]
    rows = [(i if i % 17 else None, "\n".join(rng.choice(pool).swapcase() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += rows[:2]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_lines int")
    same(linededup.dedup_lines(docs, **options), expected(rows))


def test_odd_rows(odd, odd_rows, none):
    same(linededup.dedup_lines(odd), expected([r[:2] for r in odd_rows]))
    assert linededup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_more_documents_than_a_byte_counts(spark, options):
    line = "a line that three hundred documents have"
    docs = spark.createDataFrame([(i, line) for i in range(301)] + [(i, "another line of ten documents") for i in range(10)], "doc_id bigint, text string")
    got = linededup.dedup_lines(docs, min_docs=300, **options).groupBy("n_dropped").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 11), (1, 300)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        h = linededup.PerfectHash(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        if n == 50_000:
            assert sum(x.nbytes for x in h.levels) * 8 / n < 5
            foreign = rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64)
            assert h.slots(foreign).max() < len(keys)


def test_shared_slot_hashes_are_listed_apart():
    one = np.array([5], np.uint64)
    shard = linededup.Shard(one, np.array([1], np.uint64), np.array([3]), np.array([9]))
    shard.more = {(5, 2): 7}
    h, fp, doc = np.array([5, 5, 5, 6], np.uint64), np.array([1, 2, 2, 2], np.uint64), np.array([1, 1, 7, 1])
    assert shard.drops(h, fp, doc).tolist() == [True, True, False, False]
