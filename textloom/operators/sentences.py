"""Sentence splitting: by cue words, by a character model, by a conditional random field; and chunking.

Models are parameters: weights come from a file or from the trainers here."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions.fixed import ENDERS, HONORIFICS, MONTHS, PARTICLES, STARTERS
from .arrow import byte_spans
from .normal import SPACE

Span = tuple[int, int]

# By cue words.

_PIECE = re.compile(r"[^ \t\n\r\v\f]+")
OPEN, CLOSE = "([{（「“‘«『〈", ")]}）」”’»『〉".replace("『", "』")
_ENDS, _STARTS, _MONTHS, _HONORED = tuple(ENDERS), tuple(STARTERS), tuple(MONTHS), tuple(HONORIFICS)
# Marks that end a sentence
STOPS = ("!", "?", "…", "...", "๚", "๛")
AFTER_HONORIFIC = 2


def is_digit(c: str) -> bool:
    return "0" <= c <= "9" or "๐" <= c <= "๙"


def in_date(before: str, after: str) -> bool:
    return is_digit(before[-1]) and after.startswith(_MONTHS) or before.strip() in MONTHS and is_digit(after[0])


def closed(sentence: str, after: str, most: int) -> bool:
    """Whether what was read ends here: by its mark, its last word, the next word or its length."""
    if sentence.rstrip(" \t").endswith(STOPS) or after.startswith(_STARTS):
        return True
    word = sentence.rstrip("!?ฯ.… ")
    return bool(word) and word.endswith(("ๆ", *_ENDS)) or 0 < most <= len(sentence)


def heuristic_sentences(text: str, most: int = 0) -> list[str]:
    """Pieces between blanks, joined by one blank until something ends the sentence; a line break always does."""
    out: list[str] = []
    now, depth, honored, last = "", 0, 0, 0
    for m in _PIECE.finditer(text):
        piece, gap = m.group(), text[last : m.start()]
        last = m.end()
        if now:
            hard = "\n" in gap or "\r" in gap
            if hard or not (depth > 0 or honored > 0 or in_date(now, piece)) and closed(now, piece, most):
                out.append(now)
                now = piece
            else:
                now += " " + piece
        else:
            now = piece
        depth = max(0, depth + sum(c in OPEN for c in piece) - sum(c in CLOSE for c in piece))
        honored = AFTER_HONORIFIC if piece.startswith(_HONORED) else max(0, honored - 1)
    return [*out, now] if now else out


# By a character model.

PRIME, BASIS, FULL = 1099511628211, 1469598103934665603, (1 << 64) - 1
PAD = 1 << 32
OPENERS = "\"'“‘([{"
_LONGEST = sorted(dict.fromkeys(PARTICLES), key=lambda p: -len(p))
MARKS_END = "!?…๚๛."


def mixed(kind: int, *values: int) -> int:
    h = ((BASIS ^ kind) * PRIME) & FULL
    for v in values:
        h = ((h ^ (v & FULL)) * PRIME) & FULL
    return h


def char_type(c: str) -> int:
    """A small class of a character: letter kinds, marks, digits, blanks, signs."""
    if "ก" <= c <= "ฮ":
        return 1
    if "ะ" <= c <= "ฺ" or "เ" <= c <= "๎":
        return 2
    if c.isdecimal():
        return 3
    if c.isspace():
        return 4
    if c.isalpha():
        return 5
    return 6


def char_features(text: str, i: int) -> list[int]:
    """Hashes of what stands around a cut after character i."""
    n = len(text)
    at = lambda k: ord(text[i + k]) if 0 <= i + k < n else PAD
    kind = lambda k: char_type(text[i + k]) if 0 <= i + k < n else 0
    c = {k: at(k) for k in range(-3, 4)}
    out = [mixed(0)]
    out += [mixed(1, k, c[k]) for k in range(-3, 4)]
    out += [mixed(2, k, c[k], c[k + 1]) for k in range(-3, 3)]
    out += [mixed(3, k, c[k], c[k + 1], c[k + 2]) for k in range(-3, 2)]
    out += [mixed(4, k, kind(k)) for k in (-1, 0, 1)]
    out += [mixed(5, kind(0), kind(1)), mixed(6, int(kind(0) != kind(1)))]
    particle = next((j for j, p in enumerate(_LONGEST, 1) if text.endswith(p, 0, i + 1)), 0)
    if particle:
        out.append(mixed(7, particle))
    j = i + 1
    while j < n and text[j].isspace():
        j += 1
    if j < n:
        if text[j] in OPENERS:
            out.append(mixed(8, OPENERS.index(text[j]) + 1))
        out.append(mixed(9, kind(0), char_type(text[j])))
    if text[i] == "." and i and text[i - 1].isalpha():
        out.append(mixed(10, 1))
    k = i
    while k >= 0 and i - k < 64 and not text[k].isspace():
        k -= 1
    length = i - k
    out.append(mixed(11, next((b for b, most in enumerate((1, 2, 3, 5, 8)) if length <= most), 5)))
    return out


def is_candidate(text: str, i: int) -> bool:
    """Whether a cut after character i is thought of: at the end, before a blank, after a mark, before a quote."""
    return i + 1 == len(text) or text[i + 1].isspace() or text[i] in MARKS_END or text[i + 1] in OPENERS


@dataclass
class CharModel:
    """A linear model over hashed features; a cut is made where it scores over tau."""

    weights: dict[int, float] = field(default_factory=dict)
    bits: int = 20

    def score(self, text: str, i: int) -> float:
        mask = (1 << self.bits) - 1
        return sum(self.weights.get(f & mask, 0.0) for f in char_features(text, i))

    def boundaries(self, text: str, tau: float = 0.0) -> list[int]:
        """Ends of sentences; the last character's always is."""
        ends = [i + 1 for i in range(len(text) - 1) if is_candidate(text, i) and not text[i].isspace() and self.score(text, i) > tau]
        return [*ends, len(text)] if text else []

    def split(self, text: str, tau: float = 0.0) -> list[str]:
        cuts = [0, *self.boundaries(text, tau)]
        found = (text[a:b].strip() for a, b in zip(cuts, cuts[1:], strict=False))
        return [s for s in found if s]

    @staticmethod
    def fit(examples: Sequence[tuple[str, Sequence[int]]], bits: int = 20, epochs: int = 5, seed: int = 1) -> CharModel:
        """Averaged perceptron over candidates; examples are (text, ends of sentences)."""
        mask, rng = (1 << bits) - 1, random.Random(seed)
        w: dict[int, float] = defaultdict(float)
        total: dict[int, float] = defaultdict(float)
        items = [([f & mask for f in char_features(t, i)], i + 1 in set(ends)) for t, ends in examples for i in range(len(t)) if is_candidate(t, i)]
        step = 1
        for _ in range(epochs):
            rng.shuffle(items)
            for fs, gold in items:
                if (sum(w[f] for f in fs) > 0) != gold:
                    for f in fs:
                        w[f] += 1.0 if gold else -1.0
                        total[f] += step if gold else -step
                step += 1
        return CharModel({f: v - total[f] / step for f, v in w.items() if v or total[f]}, bits)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(f"#bits\t{self.bits}\n" + "".join(f"{k}\t{v!r}\n" for k, v in sorted(self.weights.items())))

    @staticmethod
    def load(path: str) -> CharModel:
        with open(path) as f:
            bits = int(f.readline().split("\t")[1])
            return CharModel({int(a): float(b) for a, b in (line.split("\t") for line in f if line.strip())}, bits)


# By a conditional random field over tokens.

WINDOW, GRAMS = 2, 3
_END_SET, _START_SET = frozenset(ENDERS), frozenset(STARTERS)


def token_features(tokens: Sequence[str]) -> list[list[str]]:
    """Keys of each token: n-grams of words, enders and starters that begin within two tokens of it."""
    pad = ["xxpad"] * WINDOW
    rows = {"word": [*pad, *tokens, *pad]}
    rows["ender"] = ["ender" if t in _END_SET else "normal" for t in rows["word"]]
    rows["starter"] = ["starter" if t in _START_SET else "normal" for t in rows["word"]]
    out = []
    for i in range(WINDOW, WINDOW + len(tokens)):
        keys = ["bias"]
        for n in range(1, GRAMS + 1):
            for j in range(i - WINDOW, i + WINDOW + 2 - n):
                keys += [f"{name}_{n}_{j - i}_{j - i + n}=" + "|".join(row[j : j + n]) for name, row in rows.items()]
        out.append(keys)
    return out


@dataclass
class Crf:
    """Two labels, I and E; weights by key as (I, E), transitions by pair of labels."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    # Transitions II, IE, EI, EE
    transitions: tuple[float, float, float, float] = (1.071558, -0.604471, -0.710948, -2.615432)

    def labels(self, tokens: Sequence[str]) -> list[str]:
        """The best labels by Viterbi; ties prefer I."""
        if not tokens:
            return []
        zero = (0.0, 0.0)
        emit = np.array([np.sum([self.weights.get(k, zero) for k in keys], axis=0) for keys in token_features(tokens)])
        move = np.array(self.transitions).reshape(2, 2)
        value, back = emit[0], []
        for row in emit[1:]:
            step = value[:, None] + move
            back.append(step.argmax(0))
            value = step.max(0) + row
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return ["IE"[k] for k in reversed(path)]

    def split(self, tokens: Sequence[str]) -> list[str]:
        """Sentences that concatenate to the tokens: the labels, put right at marks and blanks."""
        labels = self.labels(tokens)
        out, now = [], ""
        for i, (t, label) in enumerate(zip(tokens, labels, strict=True)):
            if t.strip().endswith((".", "!", "?")):
                labels[i] = label = "E"
            elif not t.strip() and (i == 0 or labels[i - 1] == "E"):
                labels[i] = label = "I"
            now += t
            if label == "E" or i + 1 == len(tokens):
                out.append(now)
                now = ""
        return out

    @staticmethod
    def fit(examples: Sequence[tuple[Sequence[str], Sequence[str]]], epochs: int = 8, seed: int = 1) -> Crf:
        """Averaged structured perceptron; examples are (tokens, labels)."""
        rng, step = random.Random(seed), 1
        w: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(2))
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(2))
        move, move_total = np.zeros(4), np.zeros(4)
        data = [(list(t), ["IE".index(x) for x in y], token_features(t)) for t, y in examples]
        for _ in range(epochs):
            rng.shuffle(data)
            for tokens, gold, keys in data:
                got = ["IE".index(x) for x in Crf({k: tuple(w[k]) for row in keys for k in row if k in w}, tuple(move)).labels(tokens)]
                for i, (g, y) in enumerate(zip(got, gold, strict=True)):
                    if g != y:
                        change = np.where(np.arange(2) == y, 1.0, -1.0)
                        for k in keys[i]:
                            w[k] += change
                            total[k] += step * change
                    if i and (got[i - 1], g) != (gold[i - 1], y):
                        for pair, sign in (((gold[i - 1], y), 1.0), ((got[i - 1], g), -1.0)):
                            move[pair[0] * 2 + pair[1]] += sign
                            move_total[pair[0] * 2 + pair[1]] += step * sign
                step += 1
        return Crf({k: tuple(v - total[k] / step) for k, v in w.items()}, tuple(move - move_total / step))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write("#trans\t" + "\t".join(map(repr, map(float, self.transitions))) + "\n")
            f.writelines(f"{k}\t{float(a)!r}\t{float(b)!r}\n" for k, (a, b) in sorted(self.weights.items()) if "\t" not in k and "\n" not in k)

    @staticmethod
    def load(path: str) -> Crf:
        with open(path) as f:
            head = f.readline().rstrip("\n").split("\t")
            rows = [line.rstrip("\n").split("\t") for line in f]
        return Crf({k: (float(a), float(b)) for k, a, b in rows}, tuple(map(float, head[1:5])))


def whitespace_labels(tokens: Sequence[str]) -> list[str]:
    """The baseline: a token before a blank one, and the last, ends a sentence."""
    return ["E" if i + 1 == len(tokens) or not tokens[i + 1].strip() else "I" for i in range(len(tokens))]


# Ends of tokens that close a sentence, beginnings of tokens that open a turn of speech.
CLOSING = ("”", '"', "»", "」", "』", "’", ".", "!", "?", "…", "。", "！", "？")
OPENING = ("“", "«", "「", "『", "„")


def silver_labels(tokens: Sequence[str]) -> list[str]:
    """Weak labels from punctuation: a token ends a sentence if it closes one, if the next opens a turn, or if it is the last.

    Blank tokens never end one; what counts as the next token is the next that is not blank."""
    words = [(i, t.strip()) for i, t in enumerate(tokens) if t.strip()]
    labels = ["I"] * len(tokens)
    for (i, word), (_, after) in zip(words, [*words[1:], (None, None)], strict=False):
        if after is None or word.endswith(CLOSING) or after.startswith(OPENING):
            labels[i] = "E"
    return labels


# Chunks.

_MARK = re.compile(r"[ัิ-ฺ็-๎]")
_LINE = re.compile(r"[^\r\n]+")
Measure = Callable[[str], int]
Sentences = Callable[[str], Sequence[str]]


@dataclass(frozen=True)
class ChunkOptions:
    most: int
    overlap: int = 0
    measure: Measure = len
    sentences: Sentences | None = None

    def __post_init__(self) -> None:
        if self.most <= 0:
            raise ValueError("most must be over 0")
        if not 0 <= self.overlap < self.most:
            raise ValueError("overlap must be at least 0 and under most")


def trimmed(text: str, a: int, b: int) -> Span:
    space = f"[{SPACE}]*"
    a = re.compile(space).match(text, a, b).end()
    while b > a and re.match(f"[{SPACE}]", text[b - 1]):
        b -= 1
    return a, b


def paragraphs(text: str) -> list[dict]:
    """Lines (text, start, end), trimmed, none empty, with byte offsets."""
    spans = [trimmed(text, *m.span()) for m in _LINE.finditer(text)]
    return byte_spans(text, [(a, b) for a, b in spans if a < b])


def default_sentences(paragraph: str) -> list[str]:
    """Sentences with the blanks that follow each, so that they concatenate to the paragraph."""
    out, at = [], 0
    for s in heuristic_sentences(paragraph):
        for piece in s.split(" "):
            at = paragraph.index(piece, at) + len(piece)
        end = at
        while end < len(paragraph) and paragraph[end].isspace():
            end += 1
        out.append(end)
    cuts = [0, *out[:-1], len(paragraph)]
    return [paragraph[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def hard_cut(text: str, a: int, b: int, o: ChunkOptions) -> list[Span]:
    """Cuts at the longest prefix that fits, never before a mark."""
    out = []
    while a < b:
        low, high = a + 1, b
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if o.measure(text[a:mid]) <= o.most else (low, mid - 1)
        end = low
        while end > a + 1 and end < b and _MARK.match(text[end]):
            end -= 1
        while end < b and _MARK.match(text[end]):
            end += 1
        out.append((a, end))
        a = end
    return out


def paragraph_chunks(text: str, a: int, b: int, o: ChunkOptions) -> list[Span]:
    if o.measure(text[a:b]) <= o.most:
        return [(a, b)]
    units: list[tuple[int, int, bool]] = []
    at = a
    listed = list(o.sentences(text[a:b])) if o.sentences else None
    if listed is None or "".join(listed) != text[a:b]:
        listed = default_sentences(text[a:b])
    for s in listed:
        end = at + len(s)
        fits = o.measure(s) <= o.most
        units += [(at, end, True)] if fits else [(x, y, False) for x, y in hard_cut(text, at, end, o)]
        at = end
    size = [o.measure(text[x:y]) for x, y, _ in units]
    out, i, start = [], 0, 0
    while i < len(units):
        # the longest suffix of whole sentences before i that leaves room for the next unit
        first, shared = i, 0
        if i:
            while first - 1 > start and units[first - 1][2] and shared + size[first - 1] <= o.overlap and shared + size[first - 1] + size[i] <= o.most:
                first -= 1
                shared += size[first]
        j, total = i, shared
        while j < len(units) and (j == i or total + size[j] <= o.most):
            total += size[j]
            j += 1
        out.append((units[first][0], units[j - 1][1]))
        start, i = first, j
    return out


def chunks(text: str, o: ChunkOptions) -> list[dict]:
    """Chunks (text, start, end) with byte offsets, each within `most`; none crosses a line break."""
    found: list[Span] = []
    for m in _LINE.finditer(text):
        a, b = trimmed(text, *m.span())
        if a < b:
            found += [s for s in (trimmed(text, *c) for c in paragraph_chunks(text, a, b, o)) if s[0] < s[1]]
    offsets = {at: byte for at, byte in zip(sorted({x for s in found for x in s}), byte_positions(text, sorted({x for s in found for x in s})), strict=True)}
    return [{"text": text[a:b], "start": offsets[a], "end": offsets[b]} for a, b in found]


def byte_positions(text: str, at: list[int]) -> list[int]:
    out, last, byte = [], 0, 0
    for x in at:
        byte += len(text[last:x].encode("utf-8", "surrogatepass"))
        out.append(byte)
        last = x
    return out


__all__ = ["ChunkOptions", "CharModel", "Crf", "byte_spans", "chunks", "heuristic_sentences"]
