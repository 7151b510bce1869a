import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, register
from textloom.plans import corpus, dense, fusion, near, search
from textloom.sources import files
from textloom.streaming import builders

LETTERS = "abcdefghijkl"


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(11)
    rows = [(i * 3, " ".join(rng.choice(LETTERS) * rng.choice([1, 2]) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_pruned_search_is_search(spark, small):
    index = search.build(corpus.token_arrays(small))
    asked = spark.createDataFrame([(q, random.Random(q).choices(LETTERS, k=4) + ["zz", "a"]) for q in range(12)] + [(99, ["nowhere"])], "query_id int, terms array<string>")
    for k in (1, 5, 200):
        assert sorted(search.search(index, asked, k).collect()) == sorted(search.pruned_search(index, asked, k).collect())


def test_index_round_trip(spark, small, tmp_path):
    index = search.build(corpus.token_arrays(small))
    index.save(str(tmp_path))
    again = search.Index.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, ["a", "bb"])], "query_id int, terms array<string>")
    assert search.search(index, asked, scheme="ql_dirichlet").collect() == search.search(again, asked, scheme="ql_dirichlet").collect()
    assert again.totals.n == 122


def test_vocabulary_extends(spark, small):
    first = corpus.vocabulary(corpus.token_arrays(small))
    rows = first.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    more = spark.createDataFrame([(1, "new a other new")], "doc_id bigint, text string")
    both = {r.term: (r.id, r.df) for r in corpus.extend_vocabulary(first, corpus.token_arrays(more)).collect()}
    old = {r.term: (r.id, r.df) for r in rows}
    assert both["new"] == (len(rows), 1) and both["other"] == (len(rows) + 1, 1) and both["a"] == (old["a"][0], old["a"][1] + 1)


def test_dense_search_and_rescore(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id bigint, embedding array<double>").repartition(5)
    queries = rows.where("vec_id % 50 = 0 and vec_id < 900")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {q: np.lexsort((np.arange(300), -np.round(unit @ unit[q], 6)))[:5].tolist() for q in range(0, 300, 50)}
    got: dict = {}
    for r in dense.search(rows, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    candidates = dense.search(rows, queries, 300, "binary")
    again: dict = {}
    for r in dense.rescore(candidates, rows, queries, 5).orderBy("query_id", "rank").collect():
        again.setdefault(r.query_id, []).append(r.vec_id)
    assert again == want
    pq = dense.ProductQuantizer.fit(rows.where("vec_id <> 7"), parts=8, bits=6)
    close = {(r.query_id, r.vec_id) for r in dense.search(rows, queries, 20, pq.scores).collect()}
    assert sum((q, v) in close for q, vs in want.items() for v in vs) >= 0.8 * 30
    bits = rows.where("vec_id in (0, 1)").orderBy("vec_id").select(dense.sign_words(F.col("embedding"), 16).alias("b")).collect()
    pair = spark.createDataFrame([(bits[0].b, bits[1].b)], "a array<bigint>, b array<bigint>")
    assert pair.select(dense.hamming(F.col("a"), F.col("b"))).first()[0] == int(((x[0] > 0) != (x[1] > 0)).sum())


def test_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 1, 9.0), (1, "a", 2, 5.0), (1, "b", 2, 0.3), (1, "b", 3, 0.1)], "query_id int, list string, id bigint, score double")
    got = [(r.id, round(r.score, 6)) for r in fusion.rrf(hits).orderBy("rank").collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]
    assert [(r.id, r.score) for r in fusion.weighted_sum(hits, {"a": 0.5, "b": 1.0}, fusion.min_max()).orderBy("rank").collect()] == [(2, 1.0), (1, 0.5), (3, 0.0)]
    assert [r.id for r in fusion.weighted_sum(hits, {"a": 1.0}, fusion.z_score()).orderBy("rank").collect()] == [1, 3, 2]


def test_similar_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(LETTERS) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base)] + [(200, None), (220, ""), (240, base[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.query_id, r.class_id) for r in near.similar(docs, docs.where("doc_id % 20 = 0")).collect()}
    assert {(0, 0), (0, 100), (20, 20), (20, 120), (100, 0), (120, 20), (240, 0)} <= found
    assert all((a - b) % 100 == 0 or a == 240 for a, b in found)


def test_names(spark):
    names = spark.createDataFrame([(1, "ทองดี"), (2, "สมชาย")], "entity_id int, name string")
    aliases = spark.createDataFrame([(2, "ชาย")], "entity_id int, name string")
    asked = spark.createDataFrame([(1, "ทองดา"), (2, "ชาย")], "query_id int, name string")
    got = {(r.query_id, r.entity_id): r.score for r in near.sound_lookup(names, aliases, asked).collect()}
    assert got[1, 1] == pytest.approx(0.8) and got[2, 2] == 2.0


def test_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text("b\t5\n a \n\nc\tx\nb\t5\n")
    assert sorted((r.word, r.weight) for r in files.dictionary(spark, str(tmp_path / "d.txt")).collect()) == [("a", None), ("b", 5)]
    (tmp_path / "s.txt").write_text("# x\nthe\nthe\na\n")
    assert sorted(r.term for r in files.stop_words(spark, str(tmp_path / "s.txt")).collect()) == ["a", "the"]
    (tmp_path / "v.vec").write_text("2 3\nnew york 1 2 3\nx 0.5 0 -1\n")
    assert sorted((r.word, list(r.vec)) for r in files.word_vectors(spark, str(tmp_path / "v.vec")).collect()) == [("new york", [1.0, 2.0, 3.0]), ("x", [0.5, 0.0, -1.0])]
    (tmp_path / "c.conllu").write_text("# text = ab c\n1\ta\t_\tSpaceAfter=No\n2\tb\t_\t_\n2-3\tx\t_\t_\n3\tc\t_\t_\n\n# text = z\n1\tz\t_\t_\n")
    got = files.conllu(spark, str(tmp_path / "c.conllu")).orderBy("sentence").collect()
    assert [[t.form for t in r.tokens] for r in got] == [["a", "b", "c"], ["z"]] and got[0].text == "ab c" and not got[0].tokens[0].space


def test_stream_builders(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id bigint, text string").coalesce(1).write.parquet(str(source))
    spark.createDataFrame([(3, "c a")], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    table = builders.FrequencyTable(spark, str(tmp_path / "df"))
    table.start(stream(), str(tmp_path / "c1")).awaitTermination()
    assert sorted(tuple(r) for r in table.terms().collect()) == [("a", 2, 3), ("b", 2, 2), ("c", 1, 1)]
    assert table.totals().n == 3 and table.totals().coll_len == 6
    vocabulary = builders.Vocabulary(spark, str(tmp_path / "v"))
    vocabulary.start(stream(), str(tmp_path / "c2")).awaitTermination()
    rows = vocabulary.read().collect()
    assert sorted(r.id for r in rows) == [0, 1, 2] and {r.term for r in rows} == {"a", "b", "c"}


def test_graph_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(20, size=1200)] + 0.5 * rng.normal(size=(1200, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    queries = rows.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in dense.search(rows, queries, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in graph.search(rows, queries, 10, shards=3).collect()}
    assert len(found & exact) >= 0.95 * len(exact)


@pytest.mark.parametrize("codes", ["binary_sym", "scalar8_sym"])
def test_graph_over_codes(spark, codes):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 30))
    x[3] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    queries = rows.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id): r.score for r in dense.search(rows, queries, 40, codes).collect()}
    found = {(r.query_id, r.vec_id): r.score for r in graph.search(rows, queries, 10, shards=2, codes=codes).collect()}
    best = {q: sorted((s for (p, _), s in exact.items() if p == q), reverse=True)[9] for q in range(0, 500, 20)}
    assert sum(s >= best[q] - 1e-5 for (q, _), s in found.items()) >= 0.9 * len(found) and len(found) == 250
    assert all(abs(s - exact[p]) < 1e-5 for p, s in found.items() if p in exact)


def test_held_out(spark):
    rows = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in corpus.held_out(rows, "doc_id", 0.3).collect() if r.held} == set(range(0, 100, 3))
    assert corpus.held_out(rows.where("doc_id < 0"), "doc_id").count() == 0


def test_line_pipe(spark, tmp_path):
    import io

    from textloom import __main__ as pipe

    (tmp_path / "w.txt").write_text("ผม\nไป\t3\n")
    (tmp_path / "in.txt").write_text("ผมไปโรงเรียน ab\n\n")
    out = io.StringIO()
    pipe.main(["--dict", str(tmp_path / "w.txt"), "--overlay", "โรงเรียน"], io.StringIO("ผมไปโรงเรียน ab\n\n"), out)
    assert out.getvalue() == "ผม ไป โรงเรียน ab\n\n"
    words = pipe.dictionary(str(tmp_path / "w.txt"), "โรงเรียน")
    pipe.job(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), words)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["ผม ไป โรงเรียน ab", ""]


def test_sql_functions(spark):
    names = register.register(spark)
    assert "text_terms" in names
    row = spark.sql("SELECT text_terms('Ab cd'), text_sentences('One! Two'), text_nfc(NULL), text_chunks('a b')[0].end").first()
    assert list(row) == [["Ab", "cd"], ["One!", "Two"], None, 3]


def test_pq_topk_recall(spark, tmp_path):
    from textloom import catalog

    x = np.random.default_rng(9).normal(size=(2000, 64))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows, queries = catalog.vectors(spark, str(tmp_path))
    exact = {(r.query_id, r.vec_id) for r in dense.search(rows, queries, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in catalog.queries()["pq_topk"](spark, str(tmp_path)).collect()}
    assert len(found) == len(exact) == 1000 and len(found & exact) >= 0.9 * len(exact)
