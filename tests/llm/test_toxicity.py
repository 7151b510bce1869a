import random
import zlib

import numpy as np

from textloom.llm import toxicity


def corpus(n=900, seed=2):
    """An insult or a group alone is clean; together they are toxic, which no additive weights can tell from one of two."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") * 2 + rng.choice("xyz") for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["vermin"] * insult + ["martians"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(insult and group)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_pairs_are_learned(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in toxicity.score_documents(*frames(spark, docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_margins_are_the_double_loop():
    rng = np.random.default_rng(4)
    w0, w, v = 0.3, rng.normal(size=50), rng.normal(size=(50, 3))
    texts = [np.unique(rng.integers(0, 50, n)) for n in (0, 1, 2, 7, 40)]
    got, sums = toxicity.margins(w0, w, v, *toxicity.ragged(texts))
    for k, t in enumerate(texts):
        pairs = sum(float(v[i] @ v[j]) for x, i in enumerate(t) for j in t[x + 1 :])
        assert abs(got[k] - (w0 + w[t].sum() + pairs)) < 1e-9
        assert np.allclose(sums[k], v[t].sum(0))


def test_ids_of_any_kind_and_repeated_ids(spark):
    docs, labels = corpus(300)
    twice = [(f"d{i}", t) for i, t, _ in docs for _ in range(1 + (i % 3 == 0))]
    frame = spark.createDataFrame(twice, "doc_id string, text string")
    lab = spark.createDataFrame([(f"d{i}", y) for i, y in labels], "doc_id string, toxic int")
    got = toxicity.score_documents(frame, lab, train_rows=120)
    assert got.count() == len(twice) and got.schema["doc_id"].dataType.simpleString() == "string"
    assert {r.held_out == (zlib.crc32(r.doc_id.encode()) % 5 == 0) for r in got.collect()} == {True}


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a = toxicity.score_documents(*frames(spark, docs, labels)).orderBy("doc_id").collect()
    b = toxicity.score_documents(*frames(spark, docs, flipped)).orderBy("doc_id").collect()
    assert a == b


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (8, 0), (9, 0), (10, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    rows = toxicity.score_documents(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score_documents(none, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    one = toxicity.score_documents(odd, labels.where("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in one)


def test_drop_keeps_columns(spark):
    docs, labels = corpus(400)
    frame, lab = frames(spark, docs, labels)
    kept = toxicity.drop_toxic(frame, lab)
    assert kept.columns == frame.columns
    left = {r.doc_id for r in kept.collect()}
    toxic = {i for i, y in labels if y}
    assert len(left & toxic) <= 0.05 * len(toxic) and len(left - toxic) >= 0.97 * (len(labels) - len(toxic))


def test_a_kept_text_is_sent_once(spark, monkeypatch):
    docs, labels = corpus(300)
    frame, lab = frames(spark, docs, labels)
    sent, plain = [], toxicity.arrow_map
    monkeypatch.setattr(toxicity, "arrow_map", lambda df, *rest: sent.append(df.columns) or plain(df, *rest))
    kept = toxicity.drop_toxic(frame, lab)
    assert sent[-1] == frame.columns
    clean = {r.doc_id for r in toxicity.score_documents(frame, lab).collect() if not r.predicted}
    assert {tuple(r) for r in kept.collect()} == {r for r in docs if r[0] in clean}
