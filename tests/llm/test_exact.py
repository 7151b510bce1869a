import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from textloom.llm import exact

from .conftest import same


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return out


def test_odd_rows(odd, odd_rows):
    same(exact.exact_dedup(odd), expected([r[:2] for r in odd_rows]))


def test_empty(none):
    assert exact.exact_dedup(none).count() == 0
    assert exact.keep_one(none).columns == none.columns


def test_only_ascii_is_lowered(spark):
    rows = [(1, "É"), (2, "é"), (3, "AÉ"), (4, "aÉ"), (5, "İ")]
    same(exact.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")), expected(rows))


def test_index_persists_and_absorbs_only_new(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first = exact.DigestIndex(spark, path, buckets=2)
    exact.exact_dedup(frame([(1, "a"), (2, "A"), (3, "b")]), first)
    again = exact.DigestIndex(spark, path, buckets=2)
    got = exact.exact_dedup(frame([(7, "a"), (8, "c"), (9, "C")]), again).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in got} == {7: (2, False), 8: (9, False), 9: (9, True)}
    assert again.files().count() == 3
    digests = frame([(7, "a")]).select("doc_id", exact.digest(F.col("text")).alias("digest"))
    again.absorb(digests)
    assert again.files().count() == 3


def test_keep_one(odd, odd_rows):
    kept = [r.text for r in exact.keep_one(odd).collect()]
    assert sorted(map(lower, kept)) == sorted({lower(r[1]) for r in odd_rows})


def test_no_python_in_plan(odd):
    plan = exact.exact_dedup(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
