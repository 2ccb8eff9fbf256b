"""Text, count and digest expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A style is kept when its upper-cased name contains one of these.
STYLE_WORDS = ("ITALO", "DANCE", "HOUSE", "TECHNO", "CORE", "HARD", "EURO")

# Fixed value: stands in for an optional field whose node is not on the page.
UNKNOWN = "Unknown"

# The characters a text strip removes (Unicode white space and
# the four ASCII separators). Spark's own trim removes U+0020 only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(text: Column) -> Column:
    """Remove white space, line breaks included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def facet_url_name(name: Column) -> Column:
    """Facet name as it appears in a search URL: stripped, each space a ``+``."""
    return F.replace(strip(name), F.lit(" "), F.lit("+"))


def clean_count(text: Column) -> Column:
    """Count text without thousands commas; stays a string."""
    return F.replace(text, F.lit(","), F.lit(""))


def count_value(text: Column) -> Column:
    """Typed form of :func:`clean_count`; null where the text is no number."""
    return strip(clean_count(text)).try_cast("bigint")


def has_keyword(name: Column, words=STYLE_WORDS) -> Column:
    """True when the upper-cased name contains any of ``words``."""
    upper = F.upper(name)
    return reduce(Column.__or__, [upper.contains(w) for w in words])


def first_or_default(matches: Column, default: str = UNKNOWN) -> Column:
    """First element of ``matches``; ``default`` only where there is none.

    A first element that is itself null stays null: the node was there.
    """
    return F.when(F.size(matches) == 0, F.lit(default)).otherwise(F.get(matches, F.lit(0)))


def page_count(text: Column, per_page: int = 100) -> Column:
    """Number of result pages from a text such as ``1 – 100 of 1,234``."""
    total = count_value(F.substring_index(text, "of", -1))
    return F.ceil(total / F.lit(per_page)).try_cast("int")


def stamp(at=None) -> Column:
    """Crawl time to the second, as text; ``at`` fixes it for repeatable runs."""
    if at is None:
        at = F.current_timestamp()
    elif not isinstance(at, Column):
        at = F.lit(at).cast("timestamp")
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def image_data_uri(content: Column) -> Column:
    """Image bytes as a data URI; Spark's base64 breaks lines, a URI must not."""
    packed = F.translate(F.base64(content), "\r\n", "")
    return F.concat(F.lit("data:image/jpg;base64,"), packed)


def fingerprint(*cols) -> Column:
    """MD5 hex over the canonical text of ``cols``.

    Values are cast to text, so an integer year and its text form are the same
    task. Each value carries its length and null has a mark of its own, so
    neither delimiters inside values nor nulls can make two tasks collide.
    """
    parts = []
    for c in cols:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*parts).cast("binary"))
