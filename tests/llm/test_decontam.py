import random
import time

from textloom.llm import decontam

from .conftest import same

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (12, "Short question here"), (2, "..."), (3, None), (None, "no id here"), (30, "Être, où 12 àé"), (12, "Short question here")]
TEXTS = [
    None, "", "alpha beta gamma delta epsilon zeta eta theta iota kappa", "x Alpha-BETA gamma delta epsilon  zeta eta theta iota kappa lambda! y short question here",
    "short question hereafter", "shortquestion here short question here short question here", "Être où 12 àé", "ÊTRE où 12 àé", "no id here", "a " * 5000 + "short, question; here",
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(None, "short question here", 1, "z")] * 2, "doc_id bigint, text string, n_words int, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


def expected():
    rows = [*enumerate(TEXTS), (None, "short question here"), (None, "short question here")]
    items = [x for x in ITEMS if x[0] is not None]
    return [(i, *(b := decontam.brute(t, items)), b[1] > 0) for i, t in rows]


def test_brute_force(spark):
    same(decontam.decontaminate(*frames(spark)), expected())


def test_blocks_give_the_same(spark):
    docs, bench = frames(spark)
    assert decontam.blocks_of(bench, 30).select("block").distinct().count() > 1
    same(decontam.decontaminate(docs, bench, max_bytes=30), expected())


def test_empty(spark, none):
    docs, bench = frames(spark)
    assert decontam.decontaminate(none, bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_spans_are_of_the_original(spark):
    docs, bench = frames(spark)
    rows = decontam.with_spans(decontam.scan(docs, bench, text=True)).collect()
    spans = {r.doc_id: [TEXTS[r.doc_id][s.start : s.end] for s in r.spans] for r in rows if r.doc_id is not None}
    assert spans[3] == ["Alpha-BETA gamma delta epsilon  zeta eta theta iota kappa lambda", "short question here"]
    assert spans[6] == ["Être où 12 àé"] and spans[7] == ["ÊTRE où 12 àé"]


def test_filter_keeps_clean_documents(spark):
    docs, bench = frames(spark)
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 8]


def test_automaton_is_brute_force():
    rng = random.Random(5)
    for size, letters in ((10, 2), (10, 3), (3, 2), (4, 30), (1, 5)):
        for _ in range(60):
            text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüß")[:1] if letters > 3 else rng.choice("abcdefghij"[:letters]) for _ in range(n))
            items = [(str(i), text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])).encode()) for i in range(rng.randint(0, 6))]
            scanner = decontam.Scanner(sorted(items), size)
            if not scanner.empty:
                scanner.steps()
            for _ in range(5):
                body = text(rng.randint(0, 120)).encode() + b" unknown " + text(rng.randint(0, 40)).encode()
                words, hit, found = decontam.words_of(body), set(), set()
                for name, own in items:
                    for w in decontam.windows_of(decontam.words_of(own), size):
                        for i in range(len(words) - len(w) + 1):
                            if tuple(words[i : i + len(w)]) == w:
                                hit |= set(range(i, i + len(w)))
                                found.add(name)
                n, ranges, owners = scanner.scan(body)
                assert (n, {x for a, b in ranges for x in range(a, b)}, owners) == (len(words), hit, sorted(found)), (items, body)


def test_a_large_benchmark_is_one_automaton():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30_000)]
    items = [(str(i), " ".join(rng.choices(words, k=80)).encode()) for i in range(10_000)]
    assert 4_000_000 < sum(len(t) for _, t in items) < decontam.MAX_BYTES
    scanner = decontam.Scanner(items)
    scanner.steps()
    body = " ".join(rng.choices(words, k=200)).encode()
    part = items[77][1].split()[20:45]
    n, ranges, owners = scanner.scan(body + b" " + b" ".join(part) + b" " + body)
    assert (n, ranges, owners) == (425, [(200, 225)], ["77"])
    began = time.perf_counter()
    scanner.scan(b" ".join(t for _, t in items[:300]))
    assert time.perf_counter() - began < 5


def test_odd_rows(odd, odd_rows, spark):
    bench = spark.createDataFrame([(1, odd_rows[5][1]), (2, "one"), (3, "é" * 500), (4, None), (4, odd_rows[12][1])], "item_id bigint, text string")
    items = [tuple(r) for r in bench.collect()]
    got = decontam.decontaminate(odd, bench)
    long = odd_rows[12][1]
    want = []
    for i, t, *_ in odd_rows:
        if t and t.startswith(long):  # brute force over 30,000 words is too slow: every word is hit but those after
            continue
        want.append((i, *(b := decontam.brute(t, [x for x in items if x[1] != long])), b[1] > 0))
    same(got.where("n_words < 20000 and n_items < 9").select(*got.columns), want)
    n = len(decontam.words_of(long.encode()))
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in got.where("n_words >= 20000").collect()) == [(n, n, 1), (n + 1, n, 1)]
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not w[-1] for w in want)
