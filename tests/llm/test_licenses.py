import random

from textloom.llm import decontam, licenses


def brute(text):
    words = [w.decode() for w in decontam.words_of((text or "").encode())]
    places = sorted((j, label) for label, p in licenses.BASE for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


TEXTS = [
    "", None, "under the MIT license", "cc by nc cc by-nc", "CC BY NC Apache License, Version 2.0 under the mit license and under the mit license",
    "under the new mit license", "apache license version", "x " * 3000 + "cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy. THE SOFTWARE IS PROVIDED AS IS, without warranty of any kind",
    "permission is hereby granted free of charge to any new person obtaining a copy",
    "Under the GNU General Public License", "redistribution and use in source and binary forms with or without modification",
]


def test_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 0), (None, "cc by nc", 0)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, n_base int")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(i, *brute(t)) for i, t, _ in rows], key=key)
    own = {r.doc_id: r for r in got}
    assert own[8].labels == "mit" and own[8].base_labels == "" and own[8].score == 1.0
    assert own[9].labels == "" and own[10].labels == "gpl" and own[11].labels == ""
    assert all(0 <= r.score <= 1 for r in got)


def votes_of(template, words):
    """Votes by brute force: equal grams by diagonal."""
    found = {}
    for i in range(len(words) - 2):
        for p in range(len(template.words) - 2):
            if tuple(words[i : i + 3]) == template.words[p : p + 3]:
                found.setdefault(i - p, []).append(p)
    return list(found.items())


def test_a_word_put_in_moves_the_diagonal():
    template = next(t for t in licenses.TEMPLATES if t.label == "mit" and t.kind == "passage")
    votes = votes_of(template, b"permission is hereby granted free of charge to any new person obtaining a copy".split())
    assert len(votes) == 2
    groups = licenses.merged_spans(template, votes)
    assert len(groups) == 1 and groups[0][0][0] == 0


def longest(template, hits):
    """The longest chain of hits by trying all; hits are few."""
    best = 0
    for mask in range(1 << len(hits)):
        own = [hits[k] for k in range(len(hits)) if mask >> k & 1]
        if all(a[0] < b[0] and a[1] < b[1] and abs(b[0] - b[1] - a[0] + a[1]) <= template.slip for a, b in zip(own, own[1:], strict=False)):
            best = max(best, len(own))
    return best


def test_the_first_group_is_the_longest_chain():
    rng = random.Random(2)
    template = licenses.Template("x", tuple(b"w" * 30), "body")
    for _ in range(150):
        hits = sorted({(rng.randint(0, 30), rng.randint(0, 25)) for _ in range(rng.randint(1, 9))})
        groups = licenses.merged_spans(template, [(pos - p, [p]) for pos, p in hits])
        assert sorted(h for g in groups for h in g) == hits
        assert max(map(len, groups)) == longest(template, hits)


def test_words_put_into_a_body(spark):
    rng = random.Random(3)
    body = next(t for t in licenses.TEMPLATES if t.label == "bsd" and t.kind == "body")
    rows, want = [], {}
    for i in range(30):
        words = [w.decode() for w in body.words]
        for _ in range(10 if i % 2 else 0):
            words.insert(rng.randrange(len(words)), "inserted")
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = ["holder"] * 10  # ten in a row
        if i % 5 == 4:
            words = words[: len(words) // 2]  # half the body, which is not enough of it; its passages are
        before = ["lead"] * rng.randint(0, 40)
        rows.append((i, " ".join(before + words + ["tail"] * 5)))
        want[i] = len(before), len(before) + len(words)
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=tuple(t for t in licenses.TEMPLATES if t.kind == "body")).collect()}
    for i, (a, b) in want.items():
        spans = [(s.start, s.end) for s in got[i].spans if s.label == "bsd"]
        if i % 5 == 4:
            assert spans == [] and got[i].labels == ""
        else:
            assert len(spans) == 1 and abs(spans[0][0] - a) <= 4 and abs(spans[0][1] - b) <= 4 and got[i].labels == "bsd" and got[i].score >= 0.7


def test_two_copies_are_two_spans():
    for template in licenses.TEMPLATES:
        if template.kind != "base":
            words = [b"x", *template.words, b"y", b"z", *template.words]
            groups = [g for g in licenses.merged_spans(template, votes_of(template, words)) if len(g) >= 0.9 * (len(template.words) - 2)]
            assert [g[0][0] for g in groups] == [1, len(template.words) + 3], template


def test_many_rows_under_one_key_and_a_join_without_broadcast(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (7, "under the mit license")], "doc_id bigint, text string")
    docs = docs.union(spark.range(20_000).selectExpr("cast(null as bigint)", "''"))
    for limit in (licenses.BROADCAST_BYTES, 0):
        got = licenses.scan_licenses(docs, broadcast_bytes=limit).groupBy("doc_id", "n_words", "labels").count().collect()
        assert sorted((r.doc_id or 0, r.n_words, r.labels, r["count"]) for r in got) == [(0, 0, "", 20_002), (7, 4, "mit", 1)]


def test_odd_rows(odd, odd_rows, none):
    got = licenses.scan_licenses(odd).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(r[0], *brute(r[1])) for r in odd_rows], key=key)
    assert licenses.scan_licenses(none).count() == 0
