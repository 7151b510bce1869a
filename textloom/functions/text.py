"""Column functions on text that Catalyst sees through: normalization, scripts, Latin and Korean words, n-grams, folding.

Patterns keep to what Java's regex engine matches without recursion and in time linear in the text: runs are possessive
and begin where nothing of the run stands before. A null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import JOSA

#: Unicode White_Space, which SQL's trim and Java's \\s leave partly out.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: An apostrophe or hyphen that is not inside a word. The sign comes first: looking around at every character takes long.
LOOSE = r"['-](?:(?<![\p{L}\p{Nd}]['-])|(?![\p{L}\p{Nd}]))"
WORD = r"[\p{L}\p{Nd}'-]+"

# Classes of Thai characters
TONES = "่้๊๋"
ABOVE = "ัิีึืํ็"
BELOW = "ุู"
FOLLOW = "ะาำๅ"
LEAD = "เแโใไ"
SIGNS = "ฺ์ํ๎"
MARKS = ABOVE + BELOW + TONES + SIGNS
CONSONANTS = "ก-ฃค-ฅฆ-รลว-ฮ"
VOWELS = "ฤฦ" + FOLLOW + LEAD + ABOVE + BELOW
ONCE = FOLLOW + LEAD + ABOVE + BELOW + SIGNS
#: What any rule of normalization could act on.
TRIGGER = r"[\x{0E30}-\x{0E4E}\x{200B}\x{200C}\n\t]|\A |  | \z"
#: What the rules on vowels and marks need.
THAI = r"[\x{0E01}-\x{0E4E}]"


def sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def remove_zero_width(text: Column) -> Column:
    return F.translate(text, "​‌", "")


def trimmed(text: Column) -> Column:
    return sub(text, rf"\A[{SPACE}]++|(?=[{SPACE}])(?<![{SPACE}])[{SPACE}]++\z")


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks and newlines become one newline if they hold one, else one blank; then both ends are trimmed."""
    return trimmed(sub(sub(text, r"(?=[ \n])(?<! ) *+\n[ \n]*+", "\n"), r" ++", " "))


def remove_spaces_before_marks(text: Column) -> Column:
    return sub(text, rf"(?<![{VOWELS}])([{CONSONANTS}]) ([{MARKS}])", "$1$2")


def reorder_vowels(text: Column) -> Column:
    text = sub(text, "เเ", "แ")
    text = sub(text, rf"(?<![{TONES}์])([{TONES}์]++)([{ABOVE}{BELOW}]+)", "$2$1")
    text = sub(text, rf"ํ([{TONES}]*)า", "$1ำ")
    text = sub(text, rf"(?<![{FOLLOW}])([{FOLLOW}]++)([{TONES}]+)", "$2$1")
    return sub(text, "([^ฤฦ])ๅ", "$1า")


def remove_repeats(text: Column) -> Column:
    """Vowels in canonical order, a repeated vowel or sign once, of a run of tones the last."""
    text = sub(reorder_vowels(text), rf"([{ONCE}]) *(?=\1)")
    return sub(text, rf"[{TONES}]*([{TONES}])", "$1")


def remove_dangling(text: Column) -> Column:
    return sub(sub(text, rf"\A[{MARKS}]+"), rf"(?<! ) ++[{MARKS}]+", " ")


def normalize(text: Column) -> Column:
    """The five rules in order; text that none could change stays, edges included. All but the spaces' need a Thai letter."""
    spaced = collapse_spaces(remove_zero_width(text))
    thai = remove_dangling(remove_repeats(remove_spaces_before_marks(spaced)))
    return F.when(~text.rlike(TRIGGER), text).when(text.rlike(THAI), thai).otherwise(spaced)


def arabic_digits(text: Column) -> Column:
    return F.translate(text, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


#: Ranges of code points by script, tested in this order.
SCRIPTS = {
    "Thai": r"\x{0E00}-\x{0E7F}",
    "Han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "Kana": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}",
    "Hangul": r"\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "Latin": r"A-Za-z\x{00C0}-\x{024F}",
}


def script_of(char: Column) -> Column:
    """The script of a character: one of SCRIPTS, else Other for letters and Common for the rest."""
    out = F.when(char.rlike(r"\p{L}"), "Other").otherwise("Common")
    for name, ranges in reversed(SCRIPTS.items()):
        out = F.when(char.rlike(f"[{ranges}]"), name).otherwise(out)
    return out


def script_count(text: Column, name: str) -> Column:
    return F.char_length(sub(text, f"[^{SCRIPTS[name]}]")).cast("bigint")


def words(text: Column) -> Column:
    """Runs of letters and digits, inner apostrophes and hyphens included.

    A pattern that repeats a group would recurse in Java, once for each hyphen of a long chain; this one doesn't."""
    return F.regexp_extract_all(sub(text, LOOSE, " "), F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    return F.transform(words(text), F.lower)


def fields(text: Column) -> Column:
    """What Unicode white space separates, none empty."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def space_fields(text: Column) -> Column:
    """What runs of U+0020 separate; edges may be empty, an empty text gives none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " +", -1))


def korean_words(text: Column) -> Column:
    """Fields, each with its stem where a particle of several syllables ends it; every word once."""
    longest = "|".join(sorted(JOSA, key=lambda j: -len(j)))
    stem = lambda x: F.regexp_extract(x, rf"\A([\x{{AC00}}-\x{{D7A3}}]+?)(?:{longest})\z", 1)
    both = F.transform(fields(text), lambda x: F.when(stem(x) != "", F.array(x, stem(x))).otherwise(F.array(x)))
    return F.array_distinct(F.flatten(both))


def windows(text: Column, n: int) -> Column:
    """The windows of n characters of a text that has so many at least. Its characters are cut once: substring would count
    them from the start of the text for each window."""
    each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
    return F.get(F.transform(F.array(F.split(text, "")), each), F.lit(0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Windows of n characters in each field; a field of at most n characters is one."""
    size = lambda x: F.char_length(x)
    return F.flatten(F.transform(fields(text), lambda x: F.when(size(x) <= n, F.array(x)).otherwise(windows(x, n))))


def word_shingles(tokens: Column, k: int = 5) -> Column:
    """The distinct runs of k tokens, joined by NUL; all tokens as one run if there are fewer."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), "\u0000"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def char_shingles(text: Column, n: int = 5) -> Column:
    """The distinct windows of n characters, blanks included; a shorter text is one."""
    size = F.char_length(text)
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(text)).otherwise(F.array_distinct(windows(text, n)))


def is_acronym(token: Column) -> Column:
    return (F.size(F.regexp_extract_all(token, F.lit(r"\p{Lu}"), F.lit(0))) >= 2) & ~token.rlike(r"\p{Ll}")


def fold(token: Column) -> Column:
    """Lower case, but for acronyms."""
    return F.when(is_acronym(token), token).otherwise(F.lower(token))


def spells_a_word(text: Column) -> Column:
    return text.rlike(r"\A[\p{L}'\-. \p{Nd}]+\z") & text.rlike(r"\p{L}")
