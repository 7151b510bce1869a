"""Phonetic codes with state from letter to letter; the regular ones are Columns in functions.phonetic."""

from __future__ import annotations

import re

from ..functions.fixed import LK_FIRST, LK_REST
from ..functions.phonetic import SILENCED

_FIRST, _REST = (dict(zip(*t, strict=True)) for t in (LK_FIRST, LK_REST))
_TONE, _SIGN = re.compile("[่-๋]"), re.compile("[ฯฺๆ็ํ]")
_SILENCED = re.compile(re.sub(r"\\x\{(\w{4})\}", r"\\u\1", SILENCED).replace("[กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ]", "[ก-ฮ]"))
UPPER_VOWELS = frozenset("ึืุู")
LENGTH = 5


def lk82(text: str) -> str:
    """Five characters: the first consonant's class, then sounds; short vowels only separate what follows."""
    text = _SIGN.sub("", _SILENCED.sub("", _TONE.sub("", text)))
    if not text:
        return ""
    if "ก" <= text[0] <= "ฮ":
        codes, rest = [_FIRST.get(text[0], text[0])], text[1:]
    else:
        codes = [_FIRST.get(c, c) for c in text[1:2]] + [_REST.get(text[0], text[0])]
        rest = text[2:]
    vowel = None
    for i, c in enumerate(rest):
        raised = rest[i + 1 : i + 2] in UPPER_VOWELS and i + 1 < len(rest)
        code: str | None = _REST.get(c, c)
        if c in "ะัิี":
            code, vowel = "", i
        elif c in "าึืูๅ":
            vowel = i
        elif c == "ุ":
            code, vowel = "" if i and rest[i - 1] in "ตธ" else code, i
        elif c in "หอ":
            code = code if raised else None
        elif c in "ยรฤฦว":
            code = code if raised or vowel is not None and vowel == i - 1 else None
        if code is not None:
            codes.append(code)
    single = [c for i, c in enumerate(codes) if i == 0 or c != codes[i - 1]]
    return ("".join(single) + "0" * (LENGTH - 1))[:LENGTH]
