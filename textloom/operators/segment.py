"""Dictionary segmentation of Thai, Chinese and Japanese, and routing of mixed text by language.

Dictionaries are parameters: words with optional weights, from a table or a list. Positions are code points; the
public span functions of `Analyzer` give byte offsets."""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from ..functions.fixed import JOSA
from .arrow import byte_spans
from .normal import arabic_digits, fold_for_index, normalize

Span = tuple[int, int]


class Dictionary:
    """Words by length classes of their first letter: enough for prefix search, and small to ship."""

    def __init__(self, words: Iterable[str | tuple[str, int | None]] = ()):
        self.words: dict[str, int | None] = {}
        self.lengths: dict[str, list[int]] = {}
        for w in words:
            self.add(*((w, None) if isinstance(w, str) else w))

    def add(self, word: str, weight: int | None = None) -> None:
        word = word.strip()
        if word:
            self.words[word] = weight
            own = self.lengths.setdefault(word[0], [])
            if len(word) not in own:
                own.append(len(word))
                own.sort()

    def remove(self, word: str) -> None:
        if word in self.words:
            del self.words[word]
            left = sorted({len(w) for w in self.words if w[0] == word[0]})
            if left:
                self.lengths[word[0]] = left
            else:
                del self.lengths[word[0]]

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def __len__(self) -> int:
        return len(self.words)

    def weight(self, word: str) -> int:
        return self.words.get(word) or 0

    @property
    def weighted(self) -> bool:
        return any(w is not None for w in self.words.values())

    def prefix_lengths(self, text: str, at: int) -> list[int]:
        """Lengths, ascending, of the words that begin at a position."""
        if at >= len(text):
            return []
        return [n for n in self.lengths.get(text[at], ()) if at + n <= len(text) and text[at : at + n] in self.words]

    def with_prefix(self, prefix: str) -> list[str]:
        return sorted(w for w in self.words if w.startswith(prefix))

    def overlaid(self, more: Dictionary) -> Dictionary:
        """The union; weights of `more` shadow these if it has any, else these pass through."""
        both = Dictionary()
        for w, weight in self.words.items():
            both.add(w, weight)
        shadow = more.weighted
        for w, weight in more.words.items():
            both.add(w, weight if shadow or w not in self.words else self.words[w])
        return both


def subwords(d: Dictionary, word: str, most: int = 16) -> list[str]:
    """The longest dictionary words one after the other, never the whole word; letters outside are skipped."""
    out, at = [], 0
    while at < len(word) and len(out) < most:
        fits = [n for n in d.prefix_lengths(word, at) if not (at == 0 and n == len(word))]
        if fits:
            out.append(word[at : at + fits[-1]])
        at += fits[-1] if fits else 1
    return out


# Thai.

C, TONE, TAIL = "[ก-ฮ]", "[่-๋]?", "(?:[ก-ฮ][ก-ฮ]?[ูุิ]?์)?"
AHEAD = r"(?=[เ-ไก-ฮ]|\Z)"
# Character clusters, of which the first that matches counts; c, t and k as in the usual notation
CLUSTER_FORMS = """
เc็ck เcctาะk เccีtยะk เccีtย>k เcc็ck เcิc์ck เcิtck เcีtยะ?k เcืtอะ?k เc[ิีุู]tย>k เctา?ะ?k
cัtวะk c[ัื]tc[ุิะ]?k c[ิุู]์ c[ะ-ู]tk cรรc์ c็ ct[ะาำ]?k ck
แc็c แcc์ แctะ แcc็c แccc์ โctะ [เ-ไ]ct ก็ อึ หึ
"""
CLUSTER = re.compile("|".join("".join({"c": C, "t": TONE, "k": TAIL, ">": AHEAD}.get(x, x) for x in form) for form in CLUSTER_FORMS.split()))
THAI_RUN = re.compile("[\u0e00-\u0e7f]+")
NON_THAI = re.compile(r"[-a-zA-Z]+|\d+(?:[,.]\d+)*|[ \t]+|\r?\n|[^฀-๿ \t\r\n]+")
CONSONANTS = re.compile("[ก-ฮ]{1,2}")
MOST_EDGES = 50


def clusters(text: str) -> list[bool]:
    """For 0..n whether a cluster ends there; 0 is not marked."""
    ends = [True] * (len(text) + 1)
    ends[0] = False
    for run in THAI_RUN.finditer(text):  # clusters are of Thai letters, any other letter stands alone
        at, end = run.span()
        ends[at + 1 : end] = [False] * (end - at - 1)
        while at < end:
            found = CLUSTER.match(text, at)
            at = found.end() if found and found.end() > at else at + 1
            ends[at] = True
    return ends


def thai_spans(text: str, d: Dictionary) -> Iterator[Span]:
    """Maximal matching within cluster boundaries: the fewest dictionary words between points all paths share."""
    n, ends = len(text), clusters(text)
    frontier, edges, count, done = {0}, {}, 0, 0
    while frontier and (begin := min(frontier)) < n:
        frontier.discard(begin)
        for length in d.prefix_lengths(text, begin):
            if ends[begin + length]:
                edges.setdefault(begin, []).append(begin + length)
                frontier.add(begin + length)
                count += 1
                if count > MOST_EDGES:
                    break
        if len(frontier) == 1:
            goal = next(iter(frontier))
            yield from fewest(edges, done, goal)
            edges, count, done = {}, 0, goal
        elif not frontier:
            found = NON_THAI.match(text, begin)
            done = found.end() if found else resume(text, begin, ends, d)
            yield begin, done
            edges, count, frontier = {}, 0, {done}


def fewest(edges: dict[int, list[int]], start: int, goal: int) -> list[Span]:
    came, queue = {start: start}, deque([start])
    while queue and goal not in came:
        at = queue.popleft()
        for to in edges.get(at, ()):
            if to not in came:
                came[to] = at
                queue.append(to)
    path = []
    while goal in came and goal != start:
        path.append((came[goal], goal))
        goal = came[goal]
    return path[::-1]


def resume(text: str, begin: int, ends: list[bool], d: Dictionary) -> int:
    """The first boundary after `begin` at which a word or other text starts."""
    for at in range(begin + 1, len(text)):
        if not ends[at]:
            continue
        if any(ends[at + n] and not (n <= 2 and CONSONANTS.fullmatch(text, at, at + n)) for n in d.prefix_lengths(text, at)) or NON_THAI.match(text, at):
            return at
    return len(text)


def without_blanks(text: str, spans: Iterable[Span]) -> list[Span]:
    """Spans trimmed of U+0020 at both ends, none empty."""
    out = []
    for a, b in spans:
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        if a < b:
            out.append((a, b))
    return out


# Chinese and Japanese.

HAN = re.compile(r"[一-鿿㐀-䶿豈-﫿]")
JAPANESE = re.compile(r"[一-鿿㐀-䶿぀-ゟ゠-ヿｦ-ﾝ々ー]")
UNKNOWN = -100_000


def other_run(text: str, at: int, target: re.Pattern) -> int:
    """The end of a run outside the target class: letters together, digits together, anything else alone."""
    kind = lambda c: "L" if c.isalpha() else "N" if c.isdecimal() else ""
    own, end = kind(text[at]), at + 1
    while own and end < len(text) and kind(text[end]) == own and not target.match(text[end]):
        end += 1
    return end


def greedy_spans(text: str, d: Dictionary, target: re.Pattern = HAN) -> Iterator[Span]:
    """At each character of the class its longest word, or itself; blanks are dropped."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if target.match(text[at]):
            end = at + (d.prefix_lengths(text, at) or [1])[-1]
        else:
            end = other_run(text, at, target)
        yield at, end
        at = end


def best_spans(text: str, d: Dictionary, target: re.Pattern = HAN) -> Iterator[Span]:
    """In each run of the class the segmentation of the largest weight; an unknown character costs much."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif not target.match(text[at]):
            end = other_run(text, at, target)
            yield at, end
            at = end
        else:
            end = at
            while end < len(text) and target.match(text[end]):
                end += 1
            yield from ((at + a, at + b) for a, b in heaviest(text[at:end], d))
            at = end


def heaviest(run: str, d: Dictionary) -> list[Span]:
    best: list[float] = [0.0] + [float("-inf")] * len(run)
    came = [0] * (len(run) + 1)
    for i in range(len(run)):
        for n, weight in [(1, UNKNOWN), *((n, d.weight(run[i : i + n])) for n in d.prefix_lengths(run, i))]:
            if best[i] + weight > best[i + n]:
                best[i + n], came[i + n] = best[i] + weight, i
    spans, at = [], len(run)
    while at:
        spans.append((came[at], at))
        at = came[at]
    return spans[::-1]


# Latin and Korean.

#: Anything but Latin letters, ASCII digits and common signs; texts without it take the patterns' way.
UNUSUAL = re.compile("[^\x00-\xa9\xab-\xb4\xb6-\xb9\xbb-\u024f\u2010-\u2027\u2030-\u205e]")
LATIN_WORD = re.compile(r"[^\W_\xb2\xb3\xb9\xbc-\xbe]+(?:['-][^\W_\xb2\xb3\xb9\xbc-\xbe]+)*")
LATIN_LETTER = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]")


def latin_spans(text: str) -> Iterator[Span]:
    """Runs of letters and decimal digits with single inner apostrophes and hyphens."""
    if not UNUSUAL.search(text):
        yield from (m.span() for m in LATIN_WORD.finditer(text))
        return
    at, n = 0, len(text)
    good = lambda c: c.isalpha() or c.isdecimal()
    while at < n:
        if not good(text[at]):
            at += 1
            continue
        end = at + 1
        while end < n and (good(text[end]) or text[end] in "'-" and end + 1 < n and good(text[end + 1])):
            end += 1
        yield at, end
        at = end


LONGEST_JOSA = sorted(JOSA, key=lambda j: -len(j.encode()))
HANGUL = re.compile(r"[가-힣]+")


def korean_spans(text: str) -> list[Span]:
    """Fields, each with its stem where a particle ends it; a word that came before is left out."""
    out, seen = [], set()
    for m in re.finditer(r"\S+", text):
        word, spans = m.group(), [m.span()]
        particle = next((j for j in LONGEST_JOSA if word.endswith(j)), None)
        if particle and HANGUL.fullmatch(word[: -len(particle)]):
            spans.append((m.start(), m.end() - len(particle)))
        for a, b in spans:
            if text[a:b] not in seen:
                seen.add(text[a:b])
                out.append((a, b))
    return out


# Mixed text.

LANGUAGES = [("thai", r"[฀-๿]"), ("han", r"[一-鿿㐀-䶿぀-ヿｦ-ﾝ々]"), ("korean", r"[가-힣ᄀ-ᇿ㄰-㆏]"), ("latin", r"[A-Za-zÀ-ɏ]")]
LANGUAGE = re.compile("|".join(f"(?P<{name}>{ranges})" for name, ranges in LANGUAGES))
KANA = re.compile(r"[぀-ヿｦ-ﾝ]")
#: Letters whose script property is Common.
COMMON_LETTERS = frozenset("ªºーｰ")


def language_of(char: str) -> str | None:
    """The language class of a letter; None for a common character."""
    if not char.isalpha() or char in COMMON_LETTERS - {"ª", "º"}:
        return None if not unicodedata.category(char).startswith("M") or not LANGUAGE.match(char) else LANGUAGE.match(char).lastgroup
    found = LANGUAGE.match(char)
    return found.lastgroup if found else "other"


def language_runs(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(language, start, end, has kana). Common characters belong to the run before them; none starts one."""
    if not UNUSUAL.search(text):
        if first := LATIN_LETTER.search(text):
            yield "latin", first.start(), len(text), False
        return
    at, n = 0, len(text)
    while at < n:
        language = language_of(text[at])
        if language is None:
            at += 1
            continue
        end = at + 1
        while end < n and language_of(text[end]) in (language, None):
            end += 1
        yield language, at, end, language == "han" and bool(KANA.search(text, at, end))
        at = end


@dataclass
class Analyzer:
    """Text to index terms: normalize, fold, route by language, cut, add parts, lower, drop stop words."""

    thai: Dictionary = field(default_factory=Dictionary)
    chinese: Dictionary = field(default_factory=Dictionary)
    japanese: Dictionary = field(default_factory=Dictionary)
    overlay: Dictionary | None = None
    stop: frozenset[str] = frozenset()
    lower_latin: bool = False
    han: str = "cn"
    use_dp: bool = False
    fold_digits: bool = False
    fold_width: bool = False
    parts: bool = False

    def prepared(self, text: str) -> str:
        text = normalize(text)
        text = arabic_digits(text) if self.fold_digits else text
        return fold_for_index(text) if self.fold_width else text

    def dictionary(self, language: str, kana: bool) -> Dictionary:
        d = self.thai if language == "thai" else self.japanese if kana or self.han == "jp" else self.chinese
        return d.overlaid(self.overlay) if self.overlay is not None else d

    def cut(self, text: str, language: str, kana: bool) -> list[Span]:
        if language == "thai":
            return without_blanks(text, thai_spans(text, self.dictionary(language, kana)))
        if language == "han":
            target = JAPANESE if kana or self.han == "jp" else HAN
            return list((best_spans if self.use_dp else greedy_spans)(text, self.dictionary(language, kana), target))
        return korean_spans(text) if language == "korean" else list(latin_spans(text))

    def spans(self, text: str) -> list[tuple[str, bool, int, int]]:
        return [(language, kana, a + i, a + j) for language, a, b, kana in language_runs(text) for i, j in self.cut(text[a:b], language, kana)]

    def tokens(self, text: str) -> dict:
        """The normalized text and its tokens with byte offsets; no stop words, lowering or parts."""
        text = self.prepared(text)
        spans = sorted((a, b) for _, _, a, b in self.spans(text))
        return {"norm": text, "tokens": byte_spans(text, spans)}

    def terms(self, text: str) -> list[str]:
        text, out = self.prepared(text), []
        for language, kana, a, b in self.spans(text):
            token = text[a:b]
            found = [token]
            if self.parts and language in ("thai", "han"):
                found += subwords(self.dictionary(language, kana), token)
            for t in found:
                t = t.lower() if self.lower_latin and language in ("latin", "other") else t
                if t not in self.stop:
                    out.append(t)
        return out

    def segment(self, text: str) -> list[str]:
        text = normalize(text)
        return [text[a:b] for _, _, a, b in self.spans(text)]


def dictionary_from(rows: Iterable[tuple[str, int | None]]) -> Dictionary:
    return Dictionary(rows)


Cut = Callable[[str], Iterable[Span]]


def pieces(text: str, cut: Cut) -> list[str]:
    return [text[a:b] for a, b in cut(text)]
