"""Normalization for algorithms that run in Python; the Column forms are in functions.text."""

from __future__ import annotations

import re
import unicodedata

from ..functions import text as T

_RE = re.compile
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TRIGGER = _RE(r"[\u0E30-\u0E4E\u200B\u200C\n\t]|\A |  | \Z")
_RULES = [
    (_RE("[\u200b\u200c]"), ""),
    (_RE(r"(?<! ) *+\n[ \n]*+"), "\n"),
    (_RE(" ++"), " "),
    (_RE(rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\Z"), ""),
    (_RE(rf"(?<![{T.VOWELS}])([{T.CONSONANTS}]) ([{T.MARKS}])"), r"\1\2"),
    (_RE("เเ"), "แ"),
    (_RE(rf"(?<![{T.TONES}์])([{T.TONES}์]++)([{T.ABOVE}{T.BELOW}]+)"), r"\2\1"),
    (_RE(rf"ํ([{T.TONES}]*)า"), r"\1ำ"),
    (_RE(rf"(?<![{T.FOLLOW}])([{T.FOLLOW}]++)([{T.TONES}]+)"), r"\2\1"),
    (_RE("([^ฤฦ])ๅ"), r"\1า"),
    (_RE(rf"([{T.ONCE}]) *(?=\1)"), ""),
    (_RE(rf"[{T.TONES}]*([{T.TONES}])"), r"\1"),
    (_RE(rf"\A[{T.MARKS}]+"), ""),
    (_RE(rf"(?<! ) ++[{T.MARKS}]+"), " "),
]
#: The rules from the fifth on need a Thai letter.
_ANY, _THAI = _RULES[:4], _RE(r"[\u0E01-\u0E4E]")
_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
#: Combining classes of the marks that have one.
CLASSES = {"\u0e3a": 9, "\u0e38": 103, "\u0e39": 103, **dict.fromkeys("\u0e48\u0e49\u0e4a\u0e4b", 107), "\u0331": 220, "\u0303": 230}
_MARK_RUN = _RE(f"[{''.join(CLASSES)}]{{2,}}")


def normalize(text: str) -> str:
    if not _TRIGGER.search(text):
        return text
    for pattern, by in _RULES if _THAI.search(text) else _ANY:
        text = pattern.sub(by, text)
    return text


def arabic_digits(text: str) -> str:
    return text.translate(_DIGITS)


def reorder(text: str) -> str:
    """Runs of marks in canonical order."""
    return _MARK_RUN.sub(lambda m: "".join(sorted(m.group(), key=CLASSES.__getitem__)), text)


def canonical(text: str) -> str:
    return reorder(normalize(text))


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


_WIDTHS = {i: chr(int(d.split()[1], 16)) for i in [0x3000, *range(0xFF00, 0xFFEF)] if (d := unicodedata.decomposition(chr(i))).startswith(("<wide>", "<narrow>"))}


def fold_width(text: str) -> str:
    """Full-width Latin and half-width kana in their usual width."""
    return text.translate(_WIDTHS)


def fold_for_index(text: str) -> str:
    return nfc(fold_width(text))


_SCRIPT = _RE("|".join(f"(?P<{name}>[{re.sub(r'\\x\{([0-9A-F]{4})\}', r'\\u\1', ranges)}])" for name, ranges in T.SCRIPTS.items()))


def script_of(char: str) -> str:
    found = _SCRIPT.match(char)
    return found.lastgroup if found else "Other" if char.isalpha() else "Common"


def script_runs(text: str) -> list[dict]:
    """Maximal runs of a script with their start in bytes; common characters stay with the run they follow."""
    runs: list[list] = []
    for at, char in enumerate(text):
        name = script_of(char)
        if runs and (name in ("Common", runs[-1][0]) or runs[-1][0] == "Common"):
            runs[-1][0] = name if runs[-1][0] == "Common" else runs[-1][0]
            runs[-1][2] = at + 1
        else:
            runs.append([name, at, at + 1])
    out, byte = [], 0
    for name, a, b in runs:
        out.append({"script": "Other" if name == "Common" else name, "text": text[a:b], "start": byte})
        byte += len(text[a:b].encode("utf-8", "surrogatepass"))
    return out
