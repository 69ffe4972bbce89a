"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that mark a request as high-risk.
MARKERS = (
    "prescreva",
    "receite",
    "prescrever",
    "receitar",
    "dose exata",
    "sem validação médica",
    "sem consultar o médico",
)


def fold(text: Column) -> Column:
    """Case folding as far as the markers can tell: the four characters whose folding ``lower`` misses, then ``lower``.

    Not a general case fold; derive the list anew if the markers change. No Unicode
    normalisation: decomposed accents don't match composed ones.
    """
    for old, new in (("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ẚ", "aʾ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.lower(text)


def has_marker(folded: Column) -> Column:
    """Whether a folded text contains a marker; an OR of ``contains``, which stays in generated code."""
    return reduce(lambda a, b: a | b, (F.contains(folded, F.lit(m)) for m in MARKERS))


def standard(text: Column) -> Column:
    """Line ends as line feeds, runs of blanks as one, no blanks at either end."""
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(text)


def mask(text: Column) -> Column:
    """E-mail addresses, IPv4 addresses and 16-digit numbers replaced by a mark.

    A local part is tried from its first character only and as a whole, so a long run without ``@`` is passed over once.
    """
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    text = F.regexp_replace(text, r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "<ip>")
    return F.regexp_replace(text, r"\b[0-9]{4}([ -]?[0-9]{4}){3}\b", "<number>")
