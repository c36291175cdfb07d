"""Text columns: trimming, words, tokens, cleaning, conditioning text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, for trimming keys and labels.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Values that stand for a missing key, read without case after trimming.
NULL_TOKENS = ("", "null", "none", "nan")
WORD = r"[\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(c) -> Column:
    """Trimmed of Unicode white space at both ends."""
    return F.btrim(_c(c), F.lit(WHITE))


def without_white(c) -> Column:
    """All white space removed."""
    return F.translate(_c(c), WHITE, "")


def key_of(c) -> Column:
    """A trimmed key; null where it is missing or one of the null tokens."""
    t = squeeze(c)
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def words(c) -> Column:
    """Maximal runs of letters and digits, lower case, in order. Null gives null."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(0))


def word_line(c) -> Column:
    """The words of a text joined by one space."""
    return F.array_join(words(c), " ")


def ascii_tokens(c) -> Column:
    """Lower-case runs of a-z, 0-9 and apostrophes; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))


def token_line(c) -> Column:
    return F.array_join(ascii_tokens(c), " ")


def clean_text(c) -> Column:
    """Line breaks to spaces, doubled quotes to one, white space collapsed; blank becomes null."""
    t = F.replace(F.regexp_replace(_c(c), "[\r\n]", " "), F.lit('""'), F.lit('"'))
    # one pass by character, then a pattern of one character, is much cheaper than a class of all white space
    return F.nullif(F.trim(F.regexp_replace(F.translate(t, WHITE, " " * len(WHITE)), " {2,}", " ")), F.lit(""))


def is_meaningful(c, least: int = 3) -> Column:
    """At least so many letters or digits."""
    return F.coalesce(F.length(F.regexp_replace(_c(c), r"[^\p{L}\p{N}]", "")) >= least, F.lit(False))


def is_missing(c) -> Column:
    """Null, blank, or a spelling of nan, none or null."""
    return F.coalesce(F.lower(F.trim(_c(c))).isin("", "nan", "none", "null"), F.lit(True))


def safe_token(c, fallback: str = "unknown") -> Column:
    """A file-system-safe token: other characters become an underscore, dots and underscores at the ends drop out."""
    t = F.btrim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^A-Za-z0-9\-_.]", "_"), F.lit("._"))
    return F.when(t == "", F.lit(fallback)).otherwise(t)


def file_stem(c) -> Column:
    """The file name without folder and last extension."""
    name = F.element_at(F.split(_c(c), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def preview(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def conditioning_text(text, emotion, template, mode: str = "emotion_template_hybrid") -> tuple[Column, Column]:
    """(conditioning text, its origin) from a cleaned text, an emotion and a template phrase.

    ``original_only`` keeps the text and falls back to the template; the hybrid mode closes the text with a full stop
    where it has no end mark and appends the tone; any other mode takes the template. A text without three letters or
    digits counts as absent.
    """
    text, emotion, template = _c(text), _c(emotion), _c(template)
    ok = is_meaningful(text)
    tone = F.concat(F.lit(" Emotional tone: "), emotion, F.lit("."))
    closed = F.when(F.substring(text, -1, 1).isin(".", "!", "?"), text).otherwise(F.concat(text, F.lit(".")))
    if mode == "original_only":
        return F.when(ok, text).otherwise(template), F.when(ok, F.lit("original")).otherwise(F.lit("template"))
    if mode == "emotion_template_hybrid":
        return F.when(ok, F.concat(closed, tone)).otherwise(template), F.when(ok, F.lit("hybrid")).otherwise(F.lit("template"))
    return template, F.lit("template")
