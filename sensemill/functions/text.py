"""Text expressions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text without comments, style, script, head and title elements and without tags; blanks run together."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("head", "style", "script", "title"):
        out = F.regexp_replace(out, rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def external_link(url: Column, excluded: str) -> Column:
    return ~F.startswith(url, F.lit("/")) & ~F.contains(url, F.lit(excluded))


def context(words: Column, at: Column, length: int, width: int = 3) -> Column:
    """Words around a phrase of ``length`` words that starts at ``at`` (from 1), the phrase left out."""
    left = F.slice(words, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)))
    right = F.slice(words, at + length, F.greatest(F.least(F.lit(width), F.size(words) - at - length + 1), F.lit(0)))
    return F.concat(left, right)


def hashed_order(key: Column, seed: str) -> Column:
    """A shuffle that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
