"""Text expressions with the whitespace rules of Python's ``split`` and ``strip``.

All functions build a Column, so they run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression character class.
WS_CLASS = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The characters of it that a regular expression's \s leaves out.
_BEYOND_REGEX = "".join(c for c in WHITESPACE if c not in "\t\n\x0b\x0c\r ")
# A word if all whitespace is Latin-1, and the range in which the other whitespace lies.
_LATIN_WORD = r"[^\t\n\x0B\f\r \x1C\x1D\x1E\x1F\x{85}\x{A0}]+"
_BEYOND_LATIN = r"[\x{1680}-\x{3000}]"

# Sentence ends and vowels of the reading-ease formula.
SENTENCE_ENDS = "[.!?]+"
VOWEL = "[aeiouyAEIOUY]"


def strip(col: Column) -> Column:
    """Whitespace removed at both ends. A character-set trim: no regex backtracking."""
    return F.btrim(col, F.lit(WHITESPACE))


def _regex_spaces(col: Column) -> Column:
    """Text in which \\s and \\S are right: a class of all whitespace is several times slower."""
    return F.translate(col, _BEYOND_REGEX, " " * len(_BEYOND_REGEX))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; null stays null, blank text is 0.

    Most texts have no character in the range of the rarer spaces and are counted directly.
    """
    rarer = F.regexp_count(_regex_spaces(col), F.lit(r"\S+"))
    usual = F.regexp_count(col, F.lit(_LATIN_WORD))
    return F.when(col.rlike(_BEYOND_LATIN), rarer).otherwise(usual).cast("bigint")


def normalise_label(col: Column) -> Column:
    """A verdict as lower-case text without outer whitespace; booleans become text."""
    return F.lower(strip(col.cast("string")))


def reading_ease(col: Column) -> Column:
    """Flesch reading ease, rounded to 6 places; null where there are no words.

    Syllables are vowel groups, at least one per word. A vowel group never spans two
    words, so the per-word sum is: all vowel groups + the words that have none.
    """
    text = _regex_spaces(col)
    words = F.nullif(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit(SENTENCE_ENDS)))
    vowel_words = F.regexp_count(text, F.lit(rf"{VOWEL}\S*"))
    syllables = F.regexp_count(text, F.lit(f"{VOWEL}+")) + words - vowel_words
    return F.round(206.835 - F.lit(1.015) * words / sentences - F.lit(84.6) * syllables / words, 6)
