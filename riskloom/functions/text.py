"""Text expressions: Column in, Column out, all of them inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space Python's str.strip removes (Spark's plain trim removes blanks only).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set, and the Unicode word characters, as the inside of a regex class (Java's \s and \w are ASCII).
SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"
# Unicode word boundary spelled out: the meaning of Java's \b depends on the JDK release.
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Replacement tags and patterns of the masking step, applied in this order.
PHONE = r"\p{Nd}{10,}"
EMAIL = BOUNDARY + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + BOUNDARY
URL = rf"(http|https)://[^{SPACE}]+"

# Contractions opened up by the cleaning step, in this order.
CONTRACTIONS = [("won't", "will not"), ("can't", "cannot"), ("n't", " not")]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalised(text: Column) -> Column:
    """Strip white space of any kind, then lower-case."""
    return F.lower(strip(text))


def masked(text: Column) -> Column:
    """Phone-like digit runs, e-mail addresses and web links become tags.

    The two costly patterns only run on rows that hold their key character.
    """
    out = F.regexp_replace(text, PHONE, "[PHONE]")
    out = F.when(text.contains("@"), F.regexp_replace(out, EMAIL, "[EMAIL]")).otherwise(out)
    return F.when(text.contains("://"), F.regexp_replace(out, URL, "[URL]")).otherwise(out)


def cleaned(text: Column) -> Column:
    """Plain prose: links shortened, contractions opened, odd symbols and repeats removed; null gives ''."""
    given = F.coalesce(text, F.lit(""))
    out = F.when(given.contains("http"), F.regexp_replace(given, f"http[^{SPACE}]+", "[URL]")).otherwise(given)
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    # White space and dropped symbols both end as one blank, so one pass takes runs of either.
    out = F.regexp_replace(out, f"[^{WORD}.,!?@$%-]+", " ")
    out = F.regexp_replace(out, r"[!?.]+([!?.])", "$1")
    return F.trim(out)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def letter_share(text: Column) -> Column:
    """Share of ASCII letters; null for empty text."""
    letters = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))
    return letters / F.nullif(F.length(text), F.lit(0))


def digit_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}+", "")) / F.nullif(F.length(text), F.lit(0))


def looks_english(text: Column, lang: Column) -> Column:
    """At least 3 tokens, half of it ASCII letters, at most 30 % digits, and tagged English."""
    three_tokens = text.rlike(f"[^{SPACE}]+[{SPACE}]+[^{SPACE}]+[{SPACE}]+[^{SPACE}]")
    # Cheapest test first: the later ones are skipped once one fails.
    test = (lang == "en") & three_tokens & (digit_share(text) <= 0.3) & (letter_share(text) >= 0.5)
    return F.coalesce(test, F.lit(False))


def length_between(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """Length gate in code points, both ends inclusive."""
    size = F.length(text)
    test = size.isNotNull()
    if low is not None:
        test = test & (size >= low)
    if high is not None:
        test = test & (size <= high)
    return test
