"""Small column predicates and scalar functions used by rules, audit and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193


def html_escape(col: Column) -> Column:
    """A3: escape & < > " ' for HTML, ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def fingerprint(col: Column) -> Column:
    """A4: SHA-256 hex of the UTF-8 text."""
    return F.sha2(col, 256)


def origin_hash(col: Column) -> Column:
    """A5: 32-bit FNV-1a over the UTF-8 bytes, eight hex digits (exact integer arithmetic)."""
    hexed = F.hex(F.encode(col, "UTF-8"))
    octets = F.filter(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda b: b != "")
    mixed = F.aggregate(
        octets,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(
            F.lit(0xFFFFFFFF).cast("long")
        ),
    )
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")


def preview(col: Column, width: int = 80) -> Column:
    """The first ``width`` characters, with an ellipsis when the text is longer."""
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("…"))).otherwise(col)


def mock_embedding(col: Column, width: int = 64) -> Column:
    """V1: code point modulo 97 of the first ``width`` characters."""
    chars = F.filter(F.split(F.substring(col, 1, width), ""), lambda c: c != "")
    return F.transform(chars, lambda c: (F.ascii(c) % 97).cast("double"))
