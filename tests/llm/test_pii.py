import hashlib
import random
import re

from textloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_rules():
    rng = random.Random(1)
    for alphabet in ("0123456789. -", "0123456789.+-() @ab\n", "ab.@-é_%+", "012.", "14 -"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(50))
            assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("a@b a@b.c.d@e.f x.y@z") == brute("a@b a@b.c.d@e.f x.y@z")


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "1 " * 150_000):
        pii.find_spans(text, pii.model())


def test_generated_sentences_of_another_seed():
    crf, hit, got, want = pii.model(), 0, 0, 0
    for text, spans in pii.generated(150, seed=99):
        found = set(crf.decode(pii.tokens(text, 0, len(text))))
        hit, got, want = hit + len(found & set(spans)), got + len(found), want + len(spans)
    assert hit / got > 0.95 and hit / want > 0.93


def test_forward_backward_sums_all_segmentations():
    edges, score = [(0, 1), (0, 2), (1, 3), (2, 3)], [0.3, -0.2, 0.5, 1.0]
    ahead, behind = pii.forward_backward(3, edges, score)
    import math

    total = 0.0
    for mask in range(16):
        chosen = [edges[k] for k in range(4) if mask >> k & 1]
        if all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(chosen) for b in chosen[:i]):
            total += math.exp(sum(score[k] for k in range(4) if mask >> k & 1))
    assert abs(ahead[3] - math.log(total)) < 1e-9 and abs(behind[0] - math.log(total)) < 1e-9


def test_added_spans(spark, odd, odd_rows, none):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == len(odd_rows)
    texts = {}
    for r in odd_rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in rows:
        hashes = {hashlib.sha256(pii.listed(brute(t)).encode()).hexdigest() for t in texts[r.doc_id]}
        assert r.base_sha256 in hashes
    assert pii.personal_data(none).count() == 0
    text = 'write to jane dot doe. jo.lee [at] mail [dot] org or token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" a@b.cd'
    base, every = pii.find_spans(text, pii.model())
    found = {(k, text[a:b]) for k, a, b in every}
    assert set(base) <= set(every)
    assert ("email", "jo.lee [at] mail [dot] org") in found and ("secret", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b") in found


def test_added_spans_leave_base_spans_alone():
    rng = random.Random(4)
    for text, _ in pii.generated(100, seed=5):
        text += " x@y.zz +1 (743) 555-3824 4111111111111111"
        base, every = pii.find_spans(text, pii.model())
        more = [s for s in every if s not in base]
        assert all(s[2] <= b[1] or s[1] >= b[2] for s in more for b in base)
    assert rng


def test_islands_are_the_whole_text():
    rng, crf = random.Random(12), pii.model()
    plain = lambda n: " ".join(rng.choice(["lo", "the", "at", "mi", "dot", "ver", "re.", "(ou)", "a_b", "x" * 150]) for _ in range(n))
    odd = ["8[.]8[.]8[.]8", "1 . 1 . 1 . 1", "a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d6", "key = a1b2c3d4e5f6a7b8c9d0", "7", "jo [at] (mail) [dot] org", "jo_at_mail . de", "j@ k.com", "x@y.zz", "4111111111111111at a . de"]
    added = 0
    for text in [f"{plain(60)} {t} {plain(60)}" for t in odd] + [" ".join(x for _ in range(4) for x in (plain(rng.randint(0, 50)), rng.choice(odd))) for _ in range(150)] + [t for t, _ in pii.generated(150, seed=3)]:
        base, every = pii.find_spans(text, crf)
        want, at = list(base), 0
        for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
            part = text[at : max(at, a)]
            want += [(k, x + at, y + at) for k, x, y in crf.decode(pii.tokens(part, 0, len(part)))]
            at = max(at, b)
        assert sorted(every) == sorted(want), text
        added += len(every) - len(base)
    assert added > 100


def test_decode_is_the_best_segmentation():
    rng, crf = random.Random(21), pii.model()
    pool = ["12", "345", "at", "@", "dot", ".", "jo", "org", "+", "(", ")", "-", "key", "a1b2c3d4e5f60718", "8"]
    for _ in range(120):
        text = "".join(rng.choice(pool) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 9)))
        toks = pii.tokens(text, 0, len(text))
        scores = {(i, j): crf.score(f).max() for i, j, f in pii.candidates(toks)}

        def best(i, scores=scores, n=len(toks)):
            """Of all segmentations of the tokens from i."""
            if i == n:
                return 0.0
            return max([best(i + 1)] + [s + best(j) for (a, j), s in scores.items() if a == i])

        at = {a: k for k, (_, a, _) in enumerate(toks)}
        to = {b: k + 1 for k, (_, _, b) in enumerate(toks)}
        got = sum(scores[at[a], to[b]] for _, a, b in crf.decode(toks))
        assert abs(got - best(0)) < 1e-9, text
