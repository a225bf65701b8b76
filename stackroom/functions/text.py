"""Text expressions with the semantics of the web client that the data comes from."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space that a browser's String.trim() removes.  Java's
# \s covers ASCII only, so the Unicode characters are named.
TRIMMED_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"

# Percent codes that Spark's form encoding writes where a browser's
# encodeURIComponent() writes the second text instead.
URI_RESTORED = [
    ("+", "%20"),
    ("%21", "!"),
    ("%27", "'"),
    ("%28", "("),
    ("%29", ")"),
    ("%7E", "~"),
]


def trim_space(text: Column) -> Column:
    """Trim Unicode white space and byte-order marks; inner white space stays."""
    return F.regexp_replace(text, rf"^{TRIMMED_SPACE}|{TRIMMED_SPACE}\z", "")


def or_default(text: Column, default: str) -> Column:
    """NULL and the empty string both become ``default``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def parse_list(text: Column) -> Column:
    """``' a, ,b'`` -> ``['a', 'b']``."""
    parts = F.transform(F.split(text, ","), trim_space)
    return F.filter(parts, lambda part: part != "")


def format_list(items: Column) -> Column:
    """``['a', NULL, 'b']`` -> ``'a, , b'``; NULL stays NULL."""
    return F.array_join(items, ", ", "")


def contains_text(text: Column, term: str) -> Column:
    """Case-insensitive substring test in which ``%`` and ``_`` have no meaning."""
    return F.contains(F.lower(text), F.lower(F.lit(term)))


def encode_uri_component(text: Column) -> Column:
    """Percent-encode as a browser does for a query parameter."""
    encoded = F.url_encode(text)
    for written, wanted in URI_RESTORED:
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded
