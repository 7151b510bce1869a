"""Personal data: regular kinds by exact rules, further spans by a semi-Markov conditional random field.

Base spans (email, ip, card, phone) follow fixed rules, leftmost and non-overlapping for each kind. The semi-Markov
CRF adds spans the rules miss (an address written out with "at" and "dot", a number in separated groups, a secret
behind its key). It scores whole candidate segments of 1 to 14 tokens by features of the segment (digit count, shape,
separators, check digits, the words before it); dynamic programming chooses boundaries and types jointly, each entity
bounded by MOST tokens. Tokens outside entities score zero and a segment without an anchor (a number, an at-sign or
its word with a dot after it) is no candidate, so the program runs exactly on islands of candidates and skips plain prose.

The weights are fitted by regularised maximum likelihood (forward-backward over segmentations) on a fixed set of
generated sentences, some hundreds; no text of the corpus is needed.

Definitions: a null or empty text has no spans; offsets are code points, end exclusive; added spans never touch base
spans; rows are independent, so ties, repeats, null doc_ids and further columns need no rule. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch, strings

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the longest run of local characters before an at-sign, which must have a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield "email", begin, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    """A chain of numbers with single dots is matched four at a time from its left."""
    for chain in CHAIN.finditer(text):
        parts = list(NUMBER.finditer(text, *chain.span()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(n := p.group().lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                yield "ip", four[0].start(), four[3].end()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            yield "phone", *m.span()


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed in KINDS, then start."""
    return [*(emails(text) if "@" in text else ()), *ips(text), *cards(text), *(phones(text) if "+" in text else ())]


# The semi-Markov CRF.

MOST = 14
TYPES = ("email", "ip", "card", "phone", "secret", "account")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Finds every token that a candidate needs: any digit, or an "at" that one name and a "dot" follow.
ANCHOR = re.compile(r"[0-9]|(?:@|(?<![^\W_])(?:at|arobase)(?![^\W_]))(?:\s{0,3}[\[\]()]){0,12}\s{0,3}(?:[^\W_]++|[^\w\s\[\]()]|_)(?:\s{0,3}[\[\]()]){0,12}\s{0,3}(?:\.|dot)")
AT, DOT = {"@", "at", "arobase"}, {".", "dot"}
KEYS = {"token", "secret", "password", "passwd", "key", "bearer", "apikey"}
NEAR = {"email": {"mail", "email", "contact", "write"}, "phone": {"call", "phone", "tel", "mobile", "fax", "ring"}, "card": {"card", "visa", "credit"}, "ip": {"ip", "host", "server", "address"}, "account": {"iban", "account", "konto", "compte"}, "secret": KEYS}
REACH = 4

Token = tuple[str, int, int]


def tokens(text: str, start: int, end: int) -> list[Token]:
    return [(m.group(), *m.span()) for m in TOKEN.finditer(text, start, end)]


def anchored(t: str) -> bool:
    return any("0" <= c <= "9" for c in t) or t in AT


def segment_features(toks: list[Token], i: int, j: int) -> list[str]:
    """Features of the whole segment i..j (end exclusive) and of the words before it; none if it is no candidate."""
    seg = [t for t, _, _ in toks[i:j]]
    gaps = [toks[k + 1][1] - toks[k][2] for k in range(i, j - 1)]
    ats = [x for x, t in enumerate(seg) if t in AT]
    mixed = [t for t in seg if t[0].isalnum() and not t.isalpha()]
    if not (seg[0][0].isalnum() or seg[0] in "+(") or not seg[-1][0].isalnum() or max(gaps, default=0) > 3:
        return []
    if len(ats) > 1 or not ats and any(t.isalpha() for t in seg):
        return []
    f = [f"n={min(j - i, 9)}"]
    others = {t for t in seg if not t[0].isalnum()}
    if ats:
        k = ats[0]
        before, after = [t for t in seg[:k] if t not in "[("], [t for t in seg[k + 1 :] if t not in "[]()"]
        dots = [x for x in range(k + 1, j - i - 1) if seg[x] in DOT]
        if not before or not dots or not seg[-1].isalpha() or not all((t in DOT) == (x % 2 == 1) for x, t in enumerate(after)):
            return []
        # a full stop close to the word before it and not to the next ends a sentence
        f.append(f"stop={any(seg[x] == '.' and gaps[x - 1] == 0 and gaps[x] > 0 for x in dots)}")
        f.append(f"tail={min(len(seg[-1]), 6)}")
        f.append(f"upper={any(t[0].isupper() for t in after)}")
        f.append(f"spelled={seg[k] != '@'}:{'dot' in after}")
        f.append(f"bracket={bool(others & {'[', '('})}")
        f.append(f"before={len(before)}:{all(g == 0 for g in gaps[: max(0, k - 1 - (seg[k - 1] in '[('))])}")
        f.append(f"local={before[-1][0].isalnum()}")
        f.append(f"clean={others <= {'.', '@', '[', ']', '(', ')', '_', '-'}}")
    else:
        digits = "".join(c for t in seg for c in t if "0" <= c <= "9")
        f.append(f"digits={min(len(digits), 24)}")
        f.append(f"seps={''.join(sorted(others))[:4]}")
        numbers = [t for t in seg if t.isascii() and t.isdigit()]
        if len(numbers) == len(mixed):
            f.append(f"groups={min(len(numbers), 6)}")
            f.append(f"lead={seg[0] if seg[0] in '+(' else '0' if seg[0][0] == '0' else ''}")
            f.append(f"wide={max(gaps, default=0) > 1}")
            f.append(f"even={len({len(t) for t in numbers}) == 1 and len(numbers) > 1}")
            if 13 <= len(digits) <= 19:
                f.append(f"luhn={luhn(digits)}:{len(numbers) > 1}")
            if len(numbers) == 4 and others <= {".", "[", "]"} and all(len(t) <= 3 and int(t) <= 255 for t in numbers):
                f.append("quad")
            f.append(f"phone-like={9 <= len(digits) <= 15 and 2 <= len(numbers) <= 5 and len(numbers[-1]) >= 4}")
        elif len(seg) == 1:
            t = seg[0]
            f.append(f"length={min(len(t) // 4, 10)}")
            f.append(f"hex={len(t) >= 16 and all(c in '0123456789abcdefABCDEF' for c in t)}")
            f.append(f"dense={0.1 < len(digits) / len(t) < 0.9}")
            f.append(f"iban={bool(re.fullmatch('[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}', t))}")
        else:
            f.append("broken")
    # a segment that goes on without a gap is a part of something
    f.append(f"cut={(i > 0 and toks[i - 1][2] == toks[i][1] and toks[i - 1][0] not in OPENING) or (j < len(toks) and toks[j][1] == toks[j - 1][2] and toks[j][0] not in CLOSING)}")
    context = {t.lower() for t, _, _ in toks[max(0, i - REACH) : i]}
    f += [f"near={kind}" for kind, cues in NEAR.items() if cues & context]
    return f


OPENING, CLOSING = set("([{<\"'=:,;*#&%!$"), set(")]}>\"',;:.!?*#&%$")


def candidates(toks: list[Token]) -> list[tuple[int, int, list[str]]]:
    """(start, end, features) of all candidate segments, at most MOST tokens each."""
    seen: set[tuple[int, int]] = set()
    for k, (t, _, _) in enumerate(toks):
        if anchored(t):
            seen.update((i, j) for i in range(max(0, k - MOST + 1), k + 1) for j in range(k + 1, min(len(toks), i + MOST) + 1))
    found = ((i, j, segment_features(toks, i, j)) for i, j in sorted(seen))
    return [(i, j, f) for i, j, f in found if f]


class SemiCRF:
    """Weights by (type, feature)."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.w = np.zeros((0, len(TYPES)))

    def rows(self, cands: list[tuple[int, int, list[str]]], grow: bool = False) -> list[list[int]]:
        if grow:
            for _, _, f in cands:
                for x in f:
                    self.ids.setdefault(x, len(self.ids))
        return [[self.ids[x] for x in f if x in self.ids] for _, _, f in cands]

    def score(self, features: list[str]) -> np.ndarray:
        """A segment's score for each type."""
        return self.w[[self.ids[x] for x in features if x in self.ids]].sum(0)

    def decode(self, toks: list[Token]) -> list[Span]:
        """The best segmentation's entities, by token boundaries as text offsets."""
        anchors = [0]
        for t, _, _ in toks:
            anchors.append(anchors[-1] + anchored(t))
        value, back = [0.0] * (len(toks) + 1), [(-1, -1)] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            value[j] = value[j - 1]
            for i in range(max(0, j - MOST), j):
                if anchors[j] > anchors[i] and (f := segment_features(toks, i, j)):
                    score = self.score(f)
                    kind = int(score.argmax())
                    if (v := value[i] + score[kind]) > value[j]:
                        value[j], back[j] = v, (i, kind)
        out, j = [], len(toks)
        while j > 0:
            i, kind = back[j]
            if i < 0:
                j -= 1
            else:
                out.append((TYPES[kind], toks[i][1], toks[j - 1][2]))
                j = i
        return out[::-1]

    def fit(self, sentences: list[tuple[str, list[Span]]], epochs: int = 30, rate: float = 0.3, l2: float = 1e-3) -> SemiCRF:
        """Maximum likelihood by full gradients (Adagrad); sentences are (text, spans)."""
        data = []
        for text, spans in sentences:
            toks = tokens(text, 0, len(text))
            cands = candidates(toks)
            rows = self.rows(cands, grow=True)
            gold = {(a, b): k for k, a, b in spans}
            want = [TYPES.index(gold[key]) if (key := (toks[i][1], toks[j - 1][2])) in gold else -1 for i, j, _ in cands]
            data.append((len(toks), [(i, j) for i, j, _ in cands], rows, want))
        self.w = np.zeros((len(self.ids), len(TYPES)))
        total = np.full_like(self.w, 1e-6)
        for _ in range(epochs):
            grad = -l2 * len(data) * self.w
            for n, edges, rows, want in data:
                if not edges:
                    continue
                s = np.array([self.w[r].sum(0) for r in rows])
                top = s.max(1)
                edge = top + np.log(np.exp(s - top[:, None]).sum(1))
                ahead, behind = forward_backward(n, edges, edge)
                p = np.exp([ahead[i] + e + behind[j] - ahead[n] for (i, j), e in zip(edges, edge, strict=True)])
                share = p[:, None] * np.exp(s - edge[:, None])
                for r, k, q in zip(rows, want, share, strict=True):
                    grad[r] -= q
                    if k >= 0:
                        grad[r, k] += 1
            total += grad**2
            self.w += rate * grad / np.sqrt(total)
        return self


def forward_backward(n: int, edges: list[tuple[int, int]], score: np.ndarray) -> tuple[list[float], list[float]]:
    """Log sums over segmentations of the tokens before and after each boundary; tokens outside entities score 0."""
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for c, (i, j) in enumerate(edges):
        ending.setdefault(j, []).append(c)
        starting.setdefault(i, []).append(c)

    def logsum(xs: list[float]) -> float:
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    for j in range(1, n + 1):
        ahead[j] = logsum([ahead[j - 1], *(ahead[edges[c][0]] + score[c] for c in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = logsum([behind[i + 1], *(behind[edges[c][1]] + score[c] for c in starting.get(i, ()))])
    return ahead, behind


def generated(n: int = 400, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words with entities written in various ways, and with numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "th", "er", "lo", "mi", "tion", "ka", "ver", "re", "ou"]) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = rng.choice("45") + num(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, str, str]:
        kind = rng.choice(TYPES)
        cue = rng.choice(["", rng.choice(sorted(NEAR[kind])) + " "]) if kind != "secret" else ""
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" @ ", " . "), (" (at) ", "."), (" at ", ".")])
            return kind, cue, f"{word()}{rng.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            return kind, cue, rng.choice([".", "[.]", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, cue, rng.choice([".", "  ", "_", " - "]).join(c[k : k + 4] for k in range(0, 16, 4))
        if kind == "phone":
            return kind, cue, rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} / {num(4)} / {num(6)}", f"0{num(2)} {num(4)} {num(4)}"])
        if kind == "secret":
            return kind, rng.choice(sorted(KEYS)) + rng.choice([" = \"", ": ", "="]), "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
        return kind, rng.choice(["iban ", "iban: ", ""]), rng.choice(["DE", "FR", "ES", "GB"]) + num(rng.choice([18, 20, 22]))

    def decoy() -> str:
        return rng.choice([num(rng.randint(1, 6)), f"{num(2)}:{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}", f"{word()} at {word()}", f"{word()} at {word()}. {rng.choice(['And', 'The', 'That', 'On', 'Erst', 'In', 'Es', 'La'])}", f"{word()} at {word()}. {word().capitalize()}", f"the key {word()}", f"a token {word()}", num(16), num(20), f"version {num(1)}.{num(1)}.{num(2)}", f"{num(3)} {num(3)}", f"{word()}{num(2)}"])

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(2, 6))) + " ", []
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.6:
                kind, cue, body = entity()
                text += cue
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + rng.choice([" ", ". ", ", ", "\" "])
            else:
                text += decoy() + rng.choice([" ", ". ", ", "])
            text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        out.append((text, spans))
    return out


@functools.cache
def model() -> SemiCRF:
    return SemiCRF().fit(generated())


#: Characters looked at first on each side of an anchor, and the tokens there that a candidate or its features can reach.
SIDE, MARGIN = 120, MOST + REACH


def enough(text: str, a: int, b: int) -> bool:
    return sum(1 for _ in itertools.islice(TOKEN.finditer(text, a, b), MARGIN)) == MARGIN


def before(text: str, at: int, floor: int) -> int:
    """Where MARGIN tokens before `at` begin; not exact at or below floor."""
    side = SIDE
    while True:
        a = max(0, at - side)
        while a > max(0, floor) and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        if a <= max(0, floor) or enough(text, a, at):
            return a
        side *= 2


def after(text: str, at: int) -> int:
    """Where MARGIN tokens after `at` end."""
    side = SIDE
    while True:
        b = RUN.match(text, min(len(text), at + side)).end()
        if b == len(text) or enough(text, at, b):
            return b
        side *= 2


RUN = re.compile(r"[^\W_]*+")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold every candidate segment and all that its features look at, so that decoding the
    parts is decoding the text; parts that touch are one, and none begins or ends inside a word."""
    begin = last = end = -1
    for m in ANCHOR.finditer(text):
        a = -1
        if last >= 0 and m.start() > max(end, last + SIDE):
            end = after(text, last)
        if last < 0 or m.start() > max(end, last + SIDE):
            a = before(text, m.start(), end)
            if last >= 0 and a > end:
                yield begin, end
            if last < 0 or a > end:
                begin, end = a, m.end()
        last = m.end()
    if last >= 0:
        yield begin, after(text, last)


def learned_spans(text: str, base: list[Span], crf: SemiCRF) -> list[Span]:
    """The CRF's spans of the text between base spans, which are settled."""
    out: list[Span] = []
    at = 0
    for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
        if a > at:
            part = text[at:a]
            for begin, end in islands(part):
                out += [(k, x + at, y + at) for k, x, y in decode_part(part, begin, end, crf)]
        at = max(at, b)
    return out


def decode_part(text: str, begin: int, end: int, crf: SemiCRF) -> list[Span]:
    toks = tokens(text, begin, end)
    if any(anchored(t) for t, _, _ in toks):
        return crf.decode(toks)
    return []


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(text: str, crf: SemiCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind as in TYPES, then start."""
    base = base_spans(text)
    return base, sorted([*base, *learned_spans(text, base, crf)], key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans of every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    fitted = model()

    def factory():
        def step(b: pa.RecordBatch):
            counts, hashes, spans = [], [], []
            for text in strings(b.column(1)):
                base, every = find_spans(text, fitted)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield batch(names, [b.column(0), *(pa.array(n[:, k].copy()) for k in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(spans, pa.string())])

        return step

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", factory)
