"""Text expressions. Every function takes and returns a Column, so it stays in generated code."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions import fixed

# Java's \b looks at all Unicode letters; the definitions use ASCII word characters only.
_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


# A boundary in front of a word character only has to look back, which is cheaper at every position of a text.
_ASCII_START = r"(?<![A-Za-z0-9_])"
_BEFORE_WORD = re.compile(r"\\b(?=(?:\((?:\?:)?)*(?:[A-Za-z0-9_]|\[(?:A-Z|a-z|0-9)[A-Za-z0-9_-]*\])(?![*?]|\{0))")
_ODD_CHOICE = re.compile(r"\|[^A-Za-z0-9(\[]|\(\|")


def ascii_regex(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite ``\\b`` to its ASCII meaning and add the case flag."""
    if not _ODD_CHOICE.search(pattern):
        pattern = _BEFORE_WORD.sub(lambda _: _ASCII_START, pattern)
    out = re.sub(r"\\b", lambda _: _ASCII_BOUNDARY, pattern)
    return f"(?i){out}" if ignore_case and not out.startswith("(?i)") else out


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(ascii_regex(pattern, ignore_case))


def replace_all(col: Column, pattern: str, to: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(col, F.lit(ascii_regex(pattern, ignore_case)), F.lit(to))


def _words(col: Column) -> Column:
    """Runs of at least two lower-case letters or digits: the parts between all other characters, one-character parts left out."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def tokens(col: Column, stop_words: list[str] = fixed.STOP_WORDS) -> Column:
    """Distinct lower-case tokens of at least two characters, sorted, without stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.sort_array(F.array_except(_words(col), stop))


def token_list(col: Column, stop_words: list[str] = fixed.STOP_WORDS) -> Column:
    """All tokens with repeats, as needed for term frequencies."""
    return F.filter(_words(col), lambda t: ~t.isin(stop_words))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 0 when either side is empty."""
    # The only element of an array, so that the overlap is taken once.
    one = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda o: o / (F.size(a) + F.size(b) - o))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(one[0])


def value_tokens(col: Column) -> Column:
    """Numbers with their marks, commas and dollar signs removed, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(ascii_regex(fixed.VALUE_TOKEN)), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, "[,$]", ""))))


def norm_key(col: Column) -> Column:
    """Lower-case key with runs of other characters as one underscore."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def clip(col: Column, n: int) -> Column:
    """Collapsed text cut with an ellipsis that counts towards ``n``."""
    s = collapse_spaces(col)
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("…"))).otherwise(s)


def snippet(col: Column, n: int = 120) -> Column:
    """Text cut within ``n`` code points, ellipsis included, spaces kept."""
    s = F.coalesce(col, F.lit(""))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


def basename(col: Column) -> Column:
    return F.element_at(F.split(col, "/"), -1)


def word_count(col: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def alnum_count(col: Column) -> Column:
    # What is left without them is counted: taking out the other characters is some twenty times slower on prose.
    text = F.coalesce(col, F.lit(""))
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z0-9]+", ""))


def deny(col: Column, words: list[str]) -> Column:
    """True when any of ``words`` occurs as a whole ASCII word."""
    return matches(F.coalesce(col, F.lit("")), r"\b(" + "|".join(re.escape(w) for w in words) + r")\b", True)


def leading(c: Column, chars: int | None) -> Column:
    """The first characters of a text, or all of it."""
    return c if chars is None else F.substring(c, 1, chars)
