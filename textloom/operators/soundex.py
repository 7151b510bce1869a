"""Complete Soundex of Thai syllables (Tapsai, Meesad and Haruechaiyasak 2020): sound and letter of the first consonant,
vowel, tone, final and second consonant of a cluster, each syllable of a word after another."""

from __future__ import annotations

import re
from collections.abc import Sequence

# The code of a first consonant, by sound class
FIRST = {c: code for letters, code in (("ก", "กก"), ("ขฃ", "คข"), ("คฅฆ", "คค"), ("ง", "งง"), ("จ", "จจ"), ("ฉชฌ", "ชช"), ("ซ", "ซซ"), ("ศษส", "ซศ"), ("ญย", "ยย"), ("ดฎ", "ดด"), ("ตฏ", "ตต"), ("ถฐ", "ทธ"), ("ทธฑฒ", "ทท"), ("นณ", "นน"), ("บ", "บบ"), ("ป", "ปป"), ("ผ", "พผ"), ("ฝ", "ฟฝ"), ("พภ", "พพ"), ("ฟ", "ฟฟ"), ("ม", "มม"), ("รลฬฤ", "รร"), ("ว", "วว"), ("หฮ", "ฮห"), ("อ", "ออ")) for c in letters}
# The sound of a final consonant
FINAL = {c: sound for letters, sound in (("กขคฆ", "ก"), ("ง", "ง"), ("จชซดตถทธศษสฎฏฐฑฒ", "ด"), ("นณญรลฬ", "น"), ("บปพฟภ", "บ"), ("ม", "ม"), ("ย", "ย"), ("ว", "ว")) for c in letters}
# Codes of vowel signs, of vowels before the consonant (with a final they bring), of tone marks
SIGNS = {"ะ": "1A", "ั": "1A", "า": "1B", "ิ": "2C", "ี": "2D", "ึ": "3E", "ื": "3F", "ุ": "4G", "ู": "4H"}
LEADS = {"โ": ("7N", ""), "ไ": ("1A", "ย"), "ใ": ("1A", "ย"), "แ": ("6L", ""), "เ": ("5J", ""), "": ("", "")}
TONES = {"่": "1", "้": "2", "๊": "3", "๋": "4"}
DEFAULTS = {"a": "1A", "o": "7M", "": "7M"}

SILENT = re.compile("[ก-ฮ][ะ-ู]?์")
PARTS = re.compile("(?P<lead>[เ-ไ]?)(?P<first>ทร|.?)(?P<rest>.*)", re.S)
#: The second consonant of a cluster: a mark follows it, or, after a vowel before the consonant, no other letter does.
CLUSTER = {False: re.compile("([รลว])[ะัิีึืุู่-๋]", re.S), True: re.compile("([รลว])(?![กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮา])", re.S)}
#: Words of several syllables that spelling alone shows, with the vowel each part implies.
SPLITS = (
    (re.compile("([ขฃฉฐถผฝศษสฮกจดตฎฏบปอ])(วรร.*)", re.S), ("a", "")),
    (re.compile("([ก-ฮ])([ก-ฮ])"), ("a", "a")),
    (re.compile("([ก-ฮ])([ก-ฮ]{2})"), ("a", "o")),
    (re.compile("([ก-ฮ])([ก-ฮ])([ก-ฮ][า-ู])"), ("a", "a", "")),
)


def parts_of(word: str) -> list[tuple[str, str]]:
    """(syllable, implied vowel) of a word taken as one syllable or as one of the patterns of two and three."""
    if word.startswith("อัต") and len(word) > 3:
        return [("อัต", ""), ("ต" + word[3:], "")]
    for pattern, implied in SPLITS:
        if found := pattern.fullmatch(word):
            return list(zip(found.groups(), implied, strict=True))
    return [(word, "")]


def last_sound(finals: str) -> tuple[str, bool]:
    """The sound of the final consonants, and whether a ro ruea beside the last one is silent."""
    if len(finals) > 1 and finals[-2] == "ร" and finals[-1] in FINAL:
        return FINAL[finals[-1]], True
    if finals.endswith("ตร"):
        return FINAL["ต"], True
    return FINAL.get(finals[-1:], "-"), False


def syllable_code(syllable: str, implied: str = "") -> str:
    lead, first, rest = PARTS.match(syllable).group("lead", "first", "rest")
    sound = "ซซ" if first == "ทร" else FIRST.get(first, "xx") if first else ""
    second = CLUSTER[bool(lead)].match(rest) if first != "ทร" else None
    cluster = second.group(1) if second else "-"
    vowel, final = LEADS[lead]
    tone, finals = "0", ""
    for c in rest[len(cluster) if second else 0 :]:
        if c in TONES:
            tone = TONES[c]
        elif c == "ำ":
            vowel, final = "1A", "ม"
        elif lead == "เ" and c == "ื":
            vowel = "BV"
        elif lead == "เ" and c == "อ":
            vowel = "BV" if vowel == "BV" else "9R"
        elif c in SIGNS:
            vowel = SIGNS[c]
        else:
            finals += c
    dropped = False
    if not final and "รร" in syllable:
        vowel, final = "1A", FINAL.get(finals[-1], "-") if finals else "น"
    elif not final:
        final, dropped = last_sound(finals)
    tone_first = first in set("ญยน") or bool(set(finals) & set("ญณ")) or vowel == "1A" and "น" in finals
    vowel = {"โ": "7N", "แ": "6L"}.get(lead) or vowel or DEFAULTS[implied]
    if first == "ส" and not implied and len(syllable) > 1 and set(re.findall("[ก-ฮ]", syllable[1:])) <= set("รลว"):
        sound = "ซซ"
    if tone_first:
        return sound + vowel + tone + final + cluster
    return sound + vowel + "-" * (dropped and final in "ก-") + final + tone + cluster


def coded(syllables: Sequence[str]) -> str:
    code = "".join(syllable_code(*part) for s in syllables for part in parts_of(s))
    word = "".join(syllables)
    marked = "ญญ" in word or "ย" in word and ("ญ" in word or "ณ" in word) or any(s.startswith("ญ") for s in syllables)
    return code + "*" * marked


def complete_soundex(word: str) -> str:
    """The code of a word of one syllable; silent letters go first. An empty word has none."""
    word = SILENT.sub("", word)
    return coded([word]) if word else ""


def complete_soundex_of(syllables: Sequence[str]) -> str:
    """The code of a word given as its syllables."""
    return coded(syllables) if syllables else ""
