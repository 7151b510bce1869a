from pyspark.sql import functions as F

from textloom.operators import soundex
from textloom.plans import corpus, discover, search


def arrays(spark, docs):
    return spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "doc_id bigint, terms array<string>").withColumn("dl", F.size("terms").cast("bigint"))


def known(*but):
    return lambda t: ~t.isin(*but)


def found(spark, docs, **rules):
    return {r.term: r for r in discover.discover(arrays(spark, docs), discover.Rules(**rules)).collect()}


LEADS = ["the", "a", "our", "that", "his", "one"]


def test_an_unknown_pair_needs_one_free_edge(spark):
    rules = {"known": known("zx", "qq"), "most_run": 2, "pmi_unknown": 0.01}
    free = found(spark, [f"{x} zx qq arrived" for x in LEADS for _ in range(3)], **rules)
    assert free["zx qq"].unknown and free["zx qq"].h_right == 0
    assert "zx qq" not in found(spark, ["the zx qq arrived"] * 18, **rules)


def test_fragments_go_and_wrappers_go(spark):
    docs = [f"{LEADS[i % 6]} {LEADS[i % 5]} gob lin kit {['ran', 'sat', 'fell', 'slept', 'hid'][i % 5]}" for i in range(60)]
    rules = {"known": known("gob", "lin", "kit"), "pmi_unknown": 0.5, "most_run": 3}
    names = set(found(spark, docs, **rules))
    assert "gob lin kit" in names and "gob lin" not in names and "lin kit" not in names
    # "armour" is an ordinary word that lives outside the term too, so the term is what it wraps
    docs = [f"{LEADS[i % 6]} ta nuki armour {['ran', 'sat', 'fell'][i % 3]}" for i in range(30)] + [f"{LEADS[i % 6]} armour {['ran', 'sat', 'fell'][i % 3]} {LEADS[i % 5]}" for i in range(40)]
    own = {"known": known("ta", "nuki"), "pmi_unknown": 0.5, "most_run": 3}
    assert "ta nuki armour" in found(spark, docs, **own) and "ta nuki" not in found(spark, docs, **own)
    peeled = found(spark, docs, affix=lambda t: t.isin("armour"), **own)
    assert "ta nuki" in peeled and "ta nuki armour" not in peeled


def test_order_and_join_without_broadcast(spark):
    docs = [f"{LEADS[i % 6]} zx qq {LEADS[i % 5]} vw yy {LEADS[i % 4]}" for i in range(40)]
    rules = discover.Rules(known=known("zx", "qq", "vw", "yy"), most_run=2, pmi_unknown=0.1)
    rows = [r.term for r in discover.discover(arrays(spark, docs), rules).collect()]
    assert rows[:2] == ["vw yy", "zx qq"]
    a, b = (sorted(tuple(r) for r in discover.candidates(arrays(spark, docs), rules, n).select("term", "uses", "pmi").collect()) for n in (discover.BROADCAST_BYTES, 0))
    assert a == b and len(a) > 4
    assert discover.discover(arrays(spark, []), rules).count() == 0


def test_rules_by_script():
    assert discover.joined_by_script(["machine", "learning"]) == "machine learning" and discover.joined_by_script(["ก็อบ", "ลิน"]) == "ก็อบลิน" and discover.joined_by_script(["中国", "人"]) == "中国人"
    assert discover.pronounceable("กา") and not discover.pronounceable("กมล") and not discover.pronounceable("กาx")


def test_routed_rules(spark):
    rules = discover.routed_rules({"ของ", "ผม"})
    rows = spark.createDataFrame([("ของ",), ("ก็อบ",), ("word",), ("x",), ("ระบบAI",)], "t string")
    got = {r.t: (r.k, r.a, r.v) for r in rows.select("t", rules.known(F.col("t")).alias("k"), rules.affix(F.col("t")).alias("a"), rules.valid(F.col("t")).alias("v")).collect()}
    assert got["ของ"][:2] == (True, True) and got["ก็อบ"][:2] == (False, False) and got["word"] == (True, True, True) and got["x"][1] is False and got["ระบบAI"][2] is False


def test_syllables():
    assert soundex.complete_soundex_of([]) == soundex.complete_soundex("") == ""
    assert soundex.complete_soundex_of(["ขา", "บาน"]) == soundex.complete_soundex("ขา") + soundex.complete_soundex("บาน")


def test_pruned_searches_are_the_full_search(spark):
    import random

    rng = random.Random(4)
    docs = [" ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randint(1, 40))) for _ in range(400)]
    made = search.build(arrays(spark, docs))
    made = search.Index(made.postings, corpus.document_frequency(made.postings), made.totals)
    asked = arrays(spark, [" ".join(f"w{rng.randint(0, 65)}" for _ in range(rng.randint(1, 5))) for _ in range(30)]).withColumnRenamed("doc_id", "query_id")
    rows = lambda df: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())
    want = rows(search.search(made, asked, 5))
    assert rows(search.pruned_search(made, asked, 5)) == want == rows(search.block_search(made, asked, 5, width=16))
