import random

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash
from textloom.llm.common import components

from .conftest import same


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute_print(t):
    w = words_of(lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """Smallest id reachable over links of 2 bits, by flooding."""
    name = {}
    distinct = sorted(set(prints.values()))
    for f in distinct:
        if f in name:
            continue
        todo, group = [f], {f}
        while todo:
            x = todo.pop()
            for y in distinct:
                if y not in group and (x ^ y).bit_count() <= 2:
                    group.add(y)
                    todo.append(y)
        ids = [i for i, p in prints.items() if p in group]
        for y in group:
            name[y] = min(ids)
    return name


def clustered(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            out.append(f)
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    return {i: f for i, f in enumerate(out)}


def test_fingerprints(odd, odd_rows):
    got = {(r.doc_id, r.fp) for r in simhash.fingerprints(odd).collect()}
    assert got == {(r[0], int(np.uint64(brute_print(r[1])).view(np.int64))) for r in odd_rows}


@pytest.mark.parametrize("limit", [simhash.BUCKET_LIMIT, 3])
def test_components_are_those_of_all_links(spark, limit):
    prints = clustered()
    frame = spark.createDataFrame([(i, i, int(np.uint64(f).view(np.int64))) for i, f in prints.items()], "doc_id bigint, th bigint, fp bigint")
    name = brute(prints)
    got = {r.doc_id: r.component_id for r in simhash.linked(frame, limit).collect()}
    assert got == {i: name[f] for i, f in prints.items()}


def test_chains_find_every_link():
    rng = random.Random(5)
    for _ in range(3000):
        f = rng.getrandbits(64)
        g = f
        for _ in range(rng.randint(0, 2)):
            g ^= 1 << rng.randrange(64)
        both = np.array([f, g], np.uint64)
        keys = simhash.bucket_keys(both)
        assert any(keys[i][0] == keys[i][1] and len(simhash.chain_links(both[0], both[1:], i)) for i in range(5))


def test_odd_rows(odd, odd_rows):
    prints = {k: brute_print(r[1]) for k, r in enumerate(odd_rows)}
    groups = {}
    for k, f in prints.items():
        groups.setdefault(f, []).append(odd_rows[k][0])
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by_print.values())
    assert {f"{f:016x}" for f in groups} == set(by_print)


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (2, text + " x"), (9, "other words here"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    linked = (brute_print(text) ^ brute_print(text + " x")).bit_count() <= 2
    assert kept == ({2, 9, None} if linked else {2, 5, 9, None})


def test_long_chains_of_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 900), (900, 950)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    same(got, [(i, 0) for i in range(201)] + [(x, 900) for x in (900, 950, 1000)])


def test_rows_of_one_doc_id_are_kept_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, b), (None, "alone"), (3, "")], "doc_id bigint, text string")
    same(simhash.keep_one(docs), [(1, a), (2, b), (None, "alone"), (3, "")])
