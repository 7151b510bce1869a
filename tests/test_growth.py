"""Work and memory that must not grow faster than the input."""

import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import weighting
from textloom.operators import arrow, segment, sketch
from textloom.plans import corpus, dense, discover, near, search


def test_results_leave_a_worker_part_by_part(spark):
    texts = pd.Series(["x" * arrow.PART, None, "y", "z" * arrow.PART, "", "w"])
    out = list(arrow.vectorized(lambda t: len(t), "bigint").func(iter([texts, texts.iloc[:0]])))
    assert [len(x) for x in out] == [1, 3, 2]
    assert [None if x is None else int(x) for part in out for x in part] == [arrow.PART, None, 1, arrow.PART, 0, 1]


def test_token_offsets_of_a_long_text():
    text = "né 학교에서 " * 40_000
    began = time.process_time()
    found = segment.Analyzer().tokens(text)["tokens"]
    assert time.process_time() - began < 10
    raw = text.encode()
    assert all(raw[t["start"] : t["end"]].decode() == t["text"] for t in random.Random(1).choices(found, k=200))


def test_clusters_of_text_without_thai_stand_alone():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("กขมรเแาะ่์็ ab漢๐ๆ") for _ in range(rng.randint(0, 30)))
        want, at = [False] * (len(text) + 1), 0
        while at < len(text):
            found = segment.CLUSTER.match(text, at)
            at = found.end() if found and found.end() > at else at + 1
            want[at] = True
        assert segment.clusters(text) == want


def test_search_makes_no_rows_of_query_and_document(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(400, None)]
    index = search.build(corpus.token_arrays(spark.createDataFrame(rows, "doc_id bigint, text string")), "postings")
    asked = spark.createDataFrame([(f"q{q}", rng.choices("abcdefghij", k=5) + ["zz", "a"]) for q in range(9)] + [(None, ["b"]), ("none", ["nowhere"])], "query_id string, terms array<string>")
    plain = lambda df: sorted(map(repr, df.collect()))
    for scheme in weighting.SCHEMES:
        found = search.search(index, asked, 7, scheme)
        assert not re.search(r"hashpartitioning\(query_id#\d+, doc_id", found._jdf.queryExecution().toString())
        assert plain(found) == plain(search.best(search.scores(index, asked, scheme), 7))
    for cells in (1, 40):  # blocks of one document and of few
        scoring = search.CELLS
        search.CELLS = cells
        try:
            assert plain(search.block_search(index, asked, 4, width=3)) == plain(search.pruned_search(index, asked, 4)) == plain(search.best(search.scores(index, asked), 4))
        finally:
            search.CELLS = scoring
    assert search.search(index, asked.where("query_id = 'none'")).collect() == []


def test_runs_are_found_in_parts(spark):
    lists = pa.array([["a"] * 3, [], ["b"] * 5, ["c"], ["d"]])
    batch = pa.RecordBatch.from_arrays([lists, pa.array(range(5))], names=["t", "i"])
    assert [b.column(1).to_pylist() for b in arrow.list_parts(iter([batch, batch.slice(2)]), 4)] == [[0, 1], [2], [3, 4], [2], [3, 4]]
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for i in range(200)], "doc_id int, terms array<string>")
    rules = discover.Rules(least_count=2)
    whole = sorted(map(repr, discover.candidates(docs, rules).collect()))
    part, discover.PART = discover.PART, 5
    try:
        assert sorted(map(repr, discover.candidates(docs, rules).collect())) == whole
    finally:
        discover.PART = part


def test_windows_of_a_long_text(spark):
    texts = ["", "a", "😀bcde", "😀bcdéf😀bcdé", "x\ny z" * 60_000, None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    began = time.monotonic()
    found = [r[0] for r in frame.select(T.char_shingles(F.col("t"))).collect()]
    assert time.monotonic() - began < 30
    for got, t in zip(found, texts, strict=True):
        assert got == (None if t is None else [] if not t else list(dict.fromkeys([t[i : i + 5] for i in range(len(t) - 4)] or [t])))
    assert frame.where("length(t) < 20").select(T.char_ngrams(F.col("t"))).collect()[3][0] == ["😀bc", "bcd", "cdé", "déf", "éf😀", "f😀b", "😀bc", "bcd", "cdé"]


def test_dense_search_holds_the_best_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(400, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [])], "vec_id bigint, embedding array<double>").repartition(3)
    queries = rows.where("vec_id % 40 = 0 or vec_id >= 900")
    plain = lambda df: sorted(map(tuple, df.collect()))
    scores = np.round(dense.cosine_scores(x[::40], x), 6) + 0.0
    want = sorted((40 * q, int(i), float(s[i]), r + 1) for q, s in enumerate(scores) for r, i in enumerate(np.lexsort((np.arange(400), -s))[:7]))
    for name, value in (("HELD", 0), ("BLOCK", 16), ("QUERIES", 3)):
        monkeypatch.setattr(dense, name, value)
    found = dense.search(rows, queries, 7)
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and plain(found) == want
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    assert plain(dense.search(rows, queries, 7)) == want
    assert dense.search(rows, queries.where("vec_id >= 900")).collect() == []


def test_exact_pairs_join_prefixes(spark):
    rng = random.Random(8)
    base = [rng.sample(range(10_000), rng.choice([1, 2, 5, 9, 10, 30])) for _ in range(40)]
    sets = [set(b) for b in base] + [set(b[: -max(1, len(b) // rng.choice([5, 9]))]) | {20_000 + i} for i, b in enumerate(base)] + [set(b) | {-1} for b in base]
    rows = spark.createDataFrame([(i, len(s), list(s)) for i, s in enumerate(sets)], "doc_id int, n int, s array<bigint>")
    found = near.exact_pairs(rows, rows.where("doc_id % 3 = 0"))
    want = {(i, j, len(a & b)) for i, a in enumerate(sets) if i % 3 == 0 for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)}
    assert sorted((r.query_id, r.doc_id, r.c) for r in found.collect()) == sorted(want)
    assert rows.select(F.sum("n")).first()[0] > 3 * rows.selectExpr("sum(n - (4 * n + 4) div 5 + 1)").first()[0] / 2


def test_embedding_of_lists_is_that_of_each(monkeypatch):
    rng, e = random.Random(2), sketch.HashingEmbedder(32)
    lists = [[rng.choice(["ab", "Éa", "ไทย", "x", ""]) + str(rng.randint(0, 9)) for _ in range(rng.choice([0, 1, 7]))] for _ in range(60)]
    words = list(dict.fromkeys(w for x in lists for w in x))
    at, sizes = np.array([words.index(w) for x in lists for w in x]), np.array([len(x) for x in lists])
    for known in (1000, 3):
        monkeypatch.setattr(sketch, "KNOWN", known)
        for _ in range(2):
            assert np.array_equal(e.embed_lists(words, at, sizes), np.array([e.embed(x) for x in lists]))


def test_normalization_of_text_without_thai_takes_few_rules(spark):
    """The other rules cannot change it, so they stand behind a test of their own."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab-' é😀\n\t​ก่า") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert T.THAI in frame.select(T.normalize(F.col("t")))._jdf.queryExecution().analyzed().toString()
    bare = T.remove_dangling(T.remove_repeats(T.remove_spaces_before_marks(T.collapse_spaces(T.remove_zero_width(F.col("t"))))))
    rows = frame.select(T.normalize(F.col("t")).alias("a"), F.when(F.col("t").rlike(T.TRIGGER), bare).otherwise(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    old = r"(?<![\p{L}\p{Nd}])['-]|['-](?![\p{L}\p{Nd}])"
    assert all(r[0] for r in frame.select(T.sub(F.col("t"), old, " ").eqNullSafe(T.sub(F.col("t"), T.LOOSE, " "))).collect())
