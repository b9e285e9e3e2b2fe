"""Language tags from stop words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# A word is a run of letters. The frequent ones are named first, as they are decided fastest.
LETTERS = r"[a-z[\p{L}]]+"

# Frequent words that mark a language. Words common to several of the languages are left
# out, as they decide nothing.
PROFILES: dict[str, tuple[str, ...]] = {
    "de": ("der", "und", "ist", "nicht", "das", "zu", "von", "mit", "ein", "ich"),
    "en": ("the", "and", "of", "to", "is", "that", "it", "for", "was", "with"),
    "es": ("el", "los", "y", "por", "una", "con", "del", "las", "para", "pero"),
    "fr": ("le", "et", "les", "des", "qui", "une", "pour", "dans", "est", "du"),
}


def language_tag(text: Column, profiles: Mapping[str, Sequence[str]] = PROFILES) -> Column:
    """Language with the most stop words in the text; ``unknown`` if there are none.

    Equal counts go to the language that sorts last. The words of a text are found in one
    pass and only its stop words are kept and counted, all within the row: no shuffle.
    """
    stop_words = sorted({w for profile in profiles.values() for w in profile})
    words = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    found = F.filter(words, lambda w: w.isin(*stop_words))

    def hits(found: Column, language: str) -> Column:
        own = profiles[language]
        return F.struct(
            F.size(F.filter(found, lambda w: w.isin(*own))).alias("n"),
            F.lit(language).alias("language"),
        )

    # The one-element array names the extracted words, so they are extracted once and
    # counted once per language.
    best = F.transform(
        F.array(found), lambda ws: F.array_max(F.array(*(hits(ws, lang) for lang in sorted(profiles))))
    )
    tag = F.transform(best, lambda b: F.when(b["n"] > 0, b["language"]).otherwise(UNKNOWN))
    return F.get(tag, F.lit(0))
