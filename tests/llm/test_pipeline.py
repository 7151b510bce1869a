import glob
import os
import subprocess
import sys

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import decontam, toxicity
from textloom.llm.common import scratch

from .test_exact import lower
from .test_nearcopies import similarity
from .test_packing import check

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "a short question"), (3, None)]


@pytest.fixture
def run(spark, tmp_path):
    def go(docs, labels):
        docs.write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        labels.write.parquet(f"{tmp_path}/labels.parquet", mode="overwrite")
        spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet", mode="overwrite")
        return corpus_pipeline.run(spark, str(tmp_path))

    return go


def grams(text):
    """Distinct 5-word shingles; A-Z count as lower case, blanks are those of ASCII."""
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def chain(rows, scores):
    """What the five stages keep of rows (doc_id, text), by brute force, given the score of each text."""
    rows = [r for r in rows if scores[r[1] or ""] < 0.5]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append((i, t))
    rows = []
    for own in groups.values():
        top = max((i for i, _ in own if i is not None), default=None)
        rows.append(next(r for r in own if r[0] == top))
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8 or not sets[a] and not sets[b]:
                root[find(a)] = find(b)
    first = {}
    for k, r in enumerate(rows):
        first.setdefault(find(k), []).append(r)
    rows = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in first.values()]
    return [r for r in rows if not decontam.brute(r[1], [x for x in ITEMS if x[1]])[1]]


def test_the_chain_is_brute_force(spark, odd, odd_rows, run):
    extra = [(200, "insult martians all the time", "en", 7, 0.5, 3, "k"), (201, "x " + ITEMS[0][1]), (202, odd_rows[5][1] + " edited"), (203, "A short question?"), (2, odd_rows[5][1] + " other words of a row that repeats an id")]
    extra = [(*r[:2], "en", 7, 0.5, 3, "k") for r in extra]
    docs = odd.union(spark.createDataFrame(extra, odd.schema))
    labels = spark.createDataFrame([(200, 1), (1, 0), (4, 0), (5, 0), (9, 0), (10, 0), (202, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = [r[:2] for r in [*odd_rows, *extra]]
    slots = toxicity.Slots()
    scores = {t or "": float(model.score([model.terms(toxicity.slots_of((t or "").encode(), slots))])[0]) for _, t in rows}
    kept = chain(rows, scores)
    got = run(docs, labels).collect()
    check(got, kept, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert 5 < len(kept) < len(rows)


def test_empty_tables(spark, none, run):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert run(none, labels).count() == 0


def test_scratch_deletes_what_a_stage_wrote(spark, odd):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/*"))
    tables = {t.name for t in spark.catalog.listTables()}  # other tests leave theirs
    with scratch(spark):
        n = corpus_pipeline.exact_copies(spark, odd, "").count()
        assert set(glob.glob(f"{root}/*")) > before
    assert n and set(glob.glob(f"{root}/*")) == before
    assert {t.name for t in spark.catalog.listTables()} == tables


@pytest.mark.parametrize("blocked", ["xxhash", "textloom.llm"])
def test_the_other_queries_stay_where_a_library_is_missing(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 50, names; assert set(e.oracle_sql()) <= names; print('pipeline' in names)"
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "False"
