import hashlib
import random

import pytest

from textloom.llm import substring

from .conftest import same


def expected(rows, window=50):
    first, split = {}, []
    for i, t in rows:
        own = substring.LOWEST if i is None else i
        words = (t or "").encode().split()
        split.append((i, own, words))
        for j in range(len(words) - window + 1):
            k = tuple(words[j : j + window])
            first[k] = min(first.get(k, own), own)
    out = []
    for i, own, words in split:
        gone = set()
        for j in range(len(words) - window + 1):
            if first[tuple(words[j : j + window])] < own:
                gone.update(range(j, j + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [substring.BROADCAST_BYTES, 0])
def test_rows_of_one_doc_id_are_judged_apart(spark, limit):
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(1, p), (2, p), (2, q), (2, q), (None, q[:100]), (3, f"{q} {p}")]
    got = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), broadcast_bytes=limit)
    same(got, expected(rows))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (1, 0), (2, 0), (2, 0), (2, 60), (3, 120)]


def test_cover_has_every_difference():
    d = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert d == set(range(substring.PERIOD))


@pytest.mark.parametrize("limit", [substring.BROADCAST_BYTES, 0])
def test_passages_at_all_alignments(spark, limit):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 5000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 64, 120)] + [["same"] * 70]
    rows = []
    for i in range(90):
        words = [word() for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 3)
            words += p[cut:] + [word() for _ in range(rng.randint(0, 40))]
        rows.append((1000 - i, " \n".join(words)))
    rows += [rows[0], (None, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, pos int")
    same(substring.dedup_substrings(docs, broadcast_bytes=limit), expected(rows))


def test_odd_rows(odd, odd_rows, none):
    rows = [r[:2] for r in odd_rows]
    same(substring.dedup_substrings(odd), expected(rows))
    assert substring.dedup_substrings(none).count() == 0
