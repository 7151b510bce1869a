"""Phonetic codes of Thai names and string similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import UDOM_FIRST, UDOM_REST
from .text import sub

CONS = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"
# Consonants by sound, coded 1 to 8
SOUNDS = ["กขฃคฆฅ", "จฉชซฌซฐทฒดฎตสศษ", "ฟฝพผภบป", "ง", "ลฬรนณฦญ", "ม", "ย", "ว"]
# Letters that a cancelling mark silences
SILENCED = rf"จน์|มณ์|ณฑ์|ทร์|ตร์|[{CONS}]์|[{CONS}][\x{{0E30}}-\x{{0E39}}]์"
MOST_CHARS = 256


def metasound(text: Column, length: int = 4) -> Column:
    """The first consonant and the sounds of those that follow; a cancelled consonant is a gap."""
    kept = sub(text, f"[^{CONS}์]")
    kept = sub(sub(kept, "[^์](?=์)", " "), "์", " ")
    codes = "".join(c for i, s in enumerate(SOUNDS, 1) for c in str(i) * len(dict.fromkeys(s)))
    letters = "".join(c for s in SOUNDS for c in dict.fromkeys(s))
    rest = sub(F.translate(F.substring(kept, 2, length - 1), letters, codes), r"[^1-8]", "0")
    return F.when(text == "", F.lit("")).otherwise(F.rpad(F.concat(F.substring(kept, 1, 1), rest), length, "0"))


def udom83(text: Column) -> Column:
    """Seven characters: rewrites of double ro ruea, ai, am and cancelled letters, then sound classes."""
    t = sub(text, r"รร([\x{0E40}-\x{0E44}])", "ัน$1")
    t = sub(t, rf"รร([{CONS}][{CONS}\x{{0E40}}-\x{{0E44}}])", "ั$1")
    t = sub(t, rf"รร([{CONS}][\x{{0E30}}-\x{{0E39}}\x{{0E48}}-\x{{0E4C}}])", "ัน$1")
    t = sub(t, "รร", "ัน")
    t = sub(t, rf"ไ([{CONS}]ย)", "$1")
    t = sub(t, rf"[ไใ]([{CONS}])", "$1ย")
    t = sub(t, r"ำ(ม[\x{0E30}-\x{0E39}])", "ม$1")
    t = sub(sub(t, "ำม", "ม"), "ำ", "ม")
    t = sub(sub(t, SILENCED), r"[\x{0E30}-\x{0E4C}]")
    code = F.concat(F.translate(F.substring(t, 1, 1), *UDOM_FIRST), F.translate(F.substring(t, 2, 1 << 30), *UDOM_REST))
    return F.when(t == "", F.lit("")).otherwise(F.substring(F.concat(code, F.lit("000000")), 1, 7))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; two empty texts are alike."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def code_similarity(a: Column, b: Column) -> Column:
    """Positions that agree as a share of the longer code."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    hits = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(hits / longest)


def keys(name: Column, lk82: Column | None = None) -> Column:
    """The distinct, not empty phonetic keys of a name, each marked by its kind."""
    found = [F.concat(F.lit("m:"), F.nullif(metasound(name), F.lit(""))), F.concat(F.lit("u:"), F.nullif(udom83(name), F.lit("")))]
    if lk82 is not None:
        found.append(F.concat(F.lit("l:"), F.nullif(lk82, F.lit(""))))
    return F.array_compact(F.array(*found))


def sounds_like(a: Column, b: Column, least: float = 0.8) -> Column:
    short = (F.char_length(a) <= MOST_CHARS) & (F.char_length(b) <= MOST_CHARS)
    return short & ((a == b) | F.arrays_overlap(keys(a), keys(b)) | (similarity(a, b) >= least))
