"""Keyword extraction and query parsing for single texts; documents are independent, so nothing is shuffled."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from ..functions.fixed import ACRONYMS, FILLER, STOP_EN
from .segment import Analyzer

SENTENCE_END = re.compile(r"[.!?…\n\r๚๛。！？]")
PUNCTUATION = re.compile(r"[^\w\s]|_")
#: Tokens that a front end remembers.
KNOWN = 100_000


class Word(NamedTuple):
    text: str
    key: str
    at: int
    start: int
    end: int
    sentence: int
    content: bool
    breaks: bool


def is_acronym(token: str) -> bool:
    if token.islower() or token[1:].islower():
        return False
    return sum(c.isupper() for c in token) >= 2 and not any(c.islower() for c in token)


def fold(token: str) -> str:
    return token if is_acronym(token) else token.lower()


@dataclass
class FrontEnd:
    """Tokens of a text with their keys, whether each is a content word, and the breaks before them."""

    analyzer: Analyzer = field(default_factory=Analyzer)
    stop: frozenset[str] = frozenset(STOP_EN)
    least: int = 2
    numbers: bool = False
    seen: dict[str, tuple[str, bool, bool]] = field(default_factory=dict, repr=False, compare=False)

    def is_content(self, token: str) -> bool:
        if not any(c.isalpha() for c in token):
            return self.numbers and any(c.isdecimal() for c in token)
        if token.lower() in self.stop:
            return False
        return len(token) >= self.least or is_acronym(token)

    def about(self, token: str) -> tuple[str, bool, bool]:
        """A token's key, whether it is a content word and whether an acronym; KNOWN tokens are remembered."""
        if len(self.seen) >= KNOWN:
            self.seen.clear()
        acronym = is_acronym(token)
        found = self.seen[token] = token if acronym else token.lower(), self.is_content(token), acronym
        return found

    def words(self, text: str) -> tuple[str, list[Word]]:
        text = self.analyzer.prepared(text)
        out: list[Word] = []
        last, sentence, seen = 0, 0, self.seen
        for a, b in sorted((a, b) for _, _, a, b in self.analyzer.spans(text)):
            if a < last:
                continue
            token, ends, breaks = text[a:b], False, not out
            if a != last + 1 or text[last] != " ":
                gap = text[last:a]
                ends = bool(SENTENCE_END.search(gap))
                sentence += bool(out) and ends
                breaks = breaks or ends or bool(PUNCTUATION.search(gap))
            key, content, _ = seen.get(token) or self.about(token)
            out.append(Word(token, key, len(out), a, b, sentence, content, breaks))
            last = b
        return text, out

    def keys(self, text: str) -> list[str]:
        return [w.key for w in self.words(text)[1]]

    def content_keys(self, text: str) -> list[str]:
        text, out, last, seen = self.analyzer.prepared(text), [], 0, self.seen
        for a, b in sorted((a, b) for _, _, a, b in self.analyzer.spans(text)):
            if a >= last:
                token, last = text[a:b], b
                key, content, _ = seen.get(token) or self.about(token)
                if content:
                    out.append(key)
        return out


Scored = list[tuple[str, float]]


def best(scores: dict[str, float], k: int) -> Scored:
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: max(k, 0)]


def tf_idf(front: FrontEnd, text: str, k: int, idf: Callable[[str], float] | None = None) -> Scored:
    counts = Counter(front.content_keys(text))
    return best({t: n * (idf(t) if idf else 1.0) for t, n in counts.items()}, k)


def phrases(words: list[Word]) -> list[list[Word]]:
    """Runs of content words that nothing breaks."""
    out: list[list[Word]] = []
    joined = False
    for w in words:
        if w.content:
            if joined and not w.breaks:
                out[-1].append(w)
            else:
                out.append([w])
        joined = w.content
    return out


def rake(front: FrontEnd, text: str, k: int) -> Scored:
    """A word scores degree / frequency, a phrase the sum of its words."""
    text, words = front.words(text)
    found = phrases(words)
    frequency: Counter = Counter()
    degree: Counter = Counter()
    for p in found:
        for w in p:
            frequency[w.key] += 1
            degree[w.key] += len(p)
    scores: dict[str, float] = {}
    for p in found:
        scores.setdefault(text[p[0].start : p[-1].end], sum(degree[w.key] / frequency[w.key] for w in p))
    return best(scores, k)


def text_rank(front: FrontEnd, text: str, k: int, window: int = 4, damping: float = 0.85, rounds: int = 30) -> Scored:
    """PageRank over content words that stand within a window of each other."""
    keys = front.content_keys(text)
    names = list(dict.fromkeys(keys))
    if len(names) <= 1:
        return best(dict.fromkeys(names, 1.0), k)
    number = {t: i for i, t in enumerate(names)}
    ids = np.array([number[t] for t in keys])
    size = len(names)
    ahead = np.concatenate([ids[:-d] * size + ids[d:] for d in range(1, window + 1)] or [np.zeros(0, int)])
    ahead = ahead[ahead // size != ahead % size]
    codes, weight = np.unique(np.concatenate([ahead, ahead % size * size + ahead // size]), return_counts=True)
    source, target = codes // size, codes % size
    out = np.bincount(source, weight, len(names))[source]
    rank = np.ones(len(names))
    for _ in range(rounds):
        rank = 1 - damping + damping * np.bincount(target, rank[source] * weight / out, len(names))
    return best(dict(zip(names, rank.tolist(), strict=True)), k)


class Uses:
    """Where a key stands: places among content words, casing, sentences and neighbours."""

    __slots__ = ("at", "upper", "capital", "sentences", "left", "right")

    def __init__(self):
        self.at, self.upper, self.capital, self.sentences, self.left, self.right = [], 0, 0, set(), [], []


def yake(front: FrontEnd, text: str, k: int) -> Scored:
    """Unigram weights from casing, position, frequency, neighbours and spread, inverted so that more is better."""
    words = front.words(text)[1]
    content = [w for w in words if w.content]
    if not content:
        return []
    sentences = len({w.sentence for w in words})
    found: dict[str, Uses] = defaultdict(Uses)
    before = None
    for i, w in enumerate(content):
        own = found[w.key]
        own.at.append(i)
        own.upper += front.about(w.text)[2] if w.text not in front.seen else front.seen[w.text][2]
        own.capital += w.text[0].isupper() and not w.breaks
        own.sentences.add(w.sentence)
        if before and before.at + 1 == w.at and not w.breaks:
            own.left.append(before.key)
            found[before.key].right.append(w.key)
        before = w
    counts = [len(own.at) for own in found.values()]
    total = sum(counts)
    deviation = math.sqrt(len(counts) * sum(c * c for c in counts) - total * total) / len(counts)
    usual, most = total / len(counts) + deviation + 1e-12, max(counts)
    diversity = lambda c: len(set(c)) / len(c) if c else 0.0
    scores = {}
    for key, own in found.items():
        tf = len(own.at)
        case = max(own.upper, own.capital) / (1 + math.log(tf))
        position = math.log(math.log(3 + (own.at[(tf - 1) // 2] + own.at[tf // 2]) / 2))
        rel = 1 + (diversity(own.left) + diversity(own.right)) * tf / most
        spread = len(own.sentences) / sentences
        raw = rel * position / (case + tf / usual / rel + spread / rel)
        scores[key] = 1 / (raw + 1e-9)
    return best(scores, k)


EXTRACTORS: dict[str, Callable[[FrontEnd, str, int], Scored]] = {"tfidf": tf_idf, "rake": rake, "textrank": text_rank, "yake": yake}


# Queries.


def canonical_form(form: str, front: FrontEnd) -> str:
    return front.analyzer.prepared(form).strip().lower()


class Groups:
    """Forms that mean the same; a form belongs to the group that took it first."""

    def __init__(self, lines: Iterable[Iterable[str]], front: FrontEnd):
        self.front = front
        self.home: dict[str, int] = {}
        self.members: list[list[str]] = []
        for forms in lines:
            self.add(list(forms))

    def add(self, forms: list[str]) -> None:
        known = [self.home[c] for f in forms if (c := canonical_form(f, self.front)) in self.home]
        at = known[0] if known else len(self.members)
        if not known:
            self.members.append([])
        for f in forms:
            c = canonical_form(f, self.front)
            if c and c not in self.home:
                self.home[c] = at
                self.members[at].append(f)

    def forms(self, term: str) -> list[str]:
        at = self.home.get(canonical_form(term, self.front))
        return [] if at is None else self.members[at]

    def retained(self, term: str) -> str | None:
        """The upper case of a Latin acronym that is known."""
        at = self.home.get(term.lower())
        if at is None or not re.fullmatch("[A-Za-z0-9]+", term):
            return None
        return term.upper() if any(f == term.upper() for f in self.members[at]) else None


class Parser:
    """Queries to terms: acronyms are kept, stop and filler words dropped, forms of the same thing added."""

    def __init__(self, front: FrontEnd | None = None, aliases: Iterable[Iterable[str]] = (), extractor: str | None = None, most: int = 0):
        front = front or FrontEnd()
        self.front = FrontEnd(front.analyzer, front.stop | frozenset(FILLER), front.least, front.numbers)
        self.groups = Groups([*(line.split() for line in ACRONYMS.strip().splitlines()), *aliases], self.front)
        self.extractor, self.most = extractor, most

    def term(self, token: str) -> str | None:
        if not any(c.isalpha() for c in token):
            return token if self.front.numbers and any(c.isdecimal() for c in token) else None
        if is_acronym(token):
            return token
        kept = self.groups.retained(token)
        if kept:
            return kept
        key = token.lower()
        return None if key in self.front.stop or len(key) < self.front.least else key

    def parse(self, query: str) -> list[str]:
        found = [t for w in self.front.words(query)[1] if (t := self.term(w.text)) is not None]
        terms = list(dict.fromkeys(found))
        if self.extractor and 0 < self.most < len(terms):
            rank = dict(EXTRACTORS[self.extractor](self.front, query, 1 << 30))
            chosen = set(sorted(terms, key=lambda t: (-rank.get(t, 0.0), terms.index(t)))[: self.most])
            terms = [t for t in terms if t in chosen]
        return terms

    def expand(self, term: str) -> list[str]:
        """The term, the upper case of a Latin one, and the other forms of its group."""
        upper = [term.upper()] if re.fullmatch("[A-Za-z0-9]+", term) else []
        return list(dict.fromkeys([term, *upper, *self.groups.forms(term)]))

    def parse_expand(self, query: str) -> list[str]:
        return list(dict.fromkeys(x for t in self.parse(query) for x in self.expand(t)))
