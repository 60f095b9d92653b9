"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_DOC_CAP, SPECIAL_TOKENS, SPLIT_PATTERN

# (?U) makes Java's \s Unicode-aware, which the pattern was written for.
JVM_SPLIT_PATTERN = "(?U)" + SPLIT_PATTERN


def crop(text: Column, cap: int = DEFAULT_DOC_CAP) -> Column:
    """First ``cap`` code points of the text; other types are cast first."""
    return F.substring(text.cast("string"), 1, cap)


def utf8_len(text: Column) -> Column:
    return F.octet_length(text)


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends (``trim`` would keep newlines)."""
    # \x1c-\x1f count as whitespace to Python but not to Java. The lookbehind
    # lets only the first blank of a run start a match, so runs stay linear.
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+\z", "")


def pretokenize(text: Column, allow_special: bool = False) -> Column:
    """Split text into pre-tokens; their concatenation is the text again.

    With ``allow_special`` each literal special string becomes one piece."""
    def pieces(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(JVM_SPLIT_PATTERN), F.lit(0))

    if not allow_special:
        return pieces(text)
    names = "|".join(rf"\Q{name}\E" for name in SPECIAL_TOKENS)
    parts = F.split(text, f"(?<={names})|(?={names})")
    return F.flatten(
        F.transform(parts, lambda p: F.when(p.isin(*SPECIAL_TOKENS), F.array(p)).otherwise(pieces(p)))
    )
