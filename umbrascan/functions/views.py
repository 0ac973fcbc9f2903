"""Normalization views as native columns (no Python per row).

Each function maps a string column to a string column.  The costly rebuilds are
guarded by one cheap character-class test, so plain ASCII text passes through.
``NUL`` works as a piece marker: the base view never contains U+0000.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

NUL = "\u0000"

# White space is written out: negated, ``\s`` or a range in a class takes several times as long.
LEET_TOKEN = r"(?<![^\t\n\x0b\f\r ])[^\t\n\x0b\f\r @431057$]*+[@431057$][^\t\n\x0b\f\r ]*+"
# The first look behind is a quick one for the second.
OCR_RUN = r"(?<![0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz])(?U)(?<!\w)[\d\s\-_.lIoOsSgGB|]{6,}(?!\w)"
FOREIGN = r"[^\x00-\x7f]"
#: white space as ``without_space`` sees it, as the inside of a character class
SPACE = r"\p{IsWhite_Space}"
SPAN_TOKEN = r"^[A-Za-z0-9+/=]{12,}$"
# What the span profile counts as printable text after decoding.
PRINTABLE = r"^[\x20-\x7e\s\x{A0}]+$"
# White space as ECMAScript defines it.
WIDE_SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _fold(col: Column, table: dict[str, str]) -> Column:
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(col, "".join(single), "".join(single.values()))
    for source, target in table.items():
        if len(target) > 1:
            out = F.replace(out, F.lit(source), F.lit(target))
    return F.when(col.rlike(tables.char_class(table)), out).otherwise(col)


def _bound(col: Column, step) -> Column:
    """``step(col)`` with ``col`` evaluated once, however often ``step`` mentions it."""
    return F.get(F.transform(F.array(col), step), 0)


def unless_same(col: Column, other: Column) -> Column:
    """``col``, null where it equals ``other``.  ``nullif`` below a condition would evaluate ``col`` twice."""
    return _bound(col, lambda c: F.when(c != other, c))


def _fold_and_drop(col: Column, table: dict[str, str], gone: str) -> Column:
    """One pass that maps single characters and deletes others; skipped if none occurs."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    long = {k: v for k, v in table.items() if len(v) > 1}
    # ``translate`` deletes source characters that have no counterpart
    out = F.translate(col, "".join(single) + gone, "".join(single.values()))
    if long:
        out = _bound(out, lambda t: _fold(t, long))
    return F.when(col.rlike(tables.char_class([*table, *gone])), out).otherwise(col)


def _rewrite_pieces(col: Column, pattern: str, rewrite) -> Column:
    """Apply ``rewrite`` to every match of ``pattern`` and leave the rest alone."""
    pieces = F.split(F.regexp_replace(col, pattern, NUL + "$0" + NUL), NUL)
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, rewrite(p)).otherwise(p)), ""
    )


def strip_null(col: Column) -> Column:
    """Drop U+0000."""
    return F.when(F.contains(col, F.lit(NUL)), F.replace(col, F.lit(NUL), F.lit(""))).otherwise(col)


def strip_invisible(col: Column, chars: str = tables.INVISIBLE) -> Column:
    """Drop zero-width and other invisible characters."""
    gone = tables.char_class(chars)
    return F.when(col.rlike(gone), F.regexp_replace(col, gone, "")).otherwise(col)


def compatibility_fold(col: Column) -> Column:
    """Single-character compatibility forms (full width, odd spaces, styled letters)."""
    return _fold(col, tables.compatibility_chars())


def exact_nfkc(col: Column) -> Column:
    """N3, complete: Unicode NFKC.  Only rows holding non-ASCII text travel to Python."""
    foreign = F.when(col.rlike(FOREIGN), col)
    return F.coalesce(F.pandas_udf(_nfkc, "string")(foreign), col)


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def lookalike_fold(col: Column, profile: str = "standard") -> Column:
    """Cyrillic and Greek letters drawn like Latin ones."""
    return _fold(col, tables.lookalikes(profile))


def span_alphabet_fold(col: Column) -> Column:
    """Whole Cyrillic and Greek alphabets, full width, quotes and dashes."""
    return _fold(col, tables.span_alphabet())


def leet_fold(col: Column) -> Column:
    """Fold leet characters inside every token that holds a letter."""
    keys, values = "".join(tables.LEET), "".join(tables.LEET.values())

    def fold(piece: Column) -> Column:
        return F.when(piece.rlike(r"\p{L}"), F.translate(piece, keys, values)).otherwise(piece)

    # a text without white space is one token
    tokens = F.contains(col, F.lit(" ")) | col.rlike(r"[\t-\r]")
    return F.when(tokens, _rewrite_pieces(col, LEET_TOKEN, fold)).otherwise(fold(col))


def leet_fold_all(col: Column) -> Column:
    """Fold leet characters everywhere."""
    return _fold(col, tables.LEET_SPANS)


def ocr_fold(col: Column) -> Column:
    """Read look-alike letters as digits inside digit-like runs."""
    keys, values = "".join(tables.OCR), "".join(tables.OCR.values())
    return _rewrite_pieces(col, OCR_RUN, lambda p: F.translate(p, keys, values))


def ocr_compact(col: Column) -> Column:
    """Drop white space and ``- _ . :``, then read look-alike letters as digits."""
    packed = F.regexp_replace(col, r"(?U)[\s\-_.:]+", "")
    return F.translate(packed, "".join(tables.OCR), "".join(tables.OCR.values()))


def dot_to_dash(col: Column) -> Column:
    """A dot between two digits becomes a dash (each match consumes both digits)."""
    return F.regexp_replace(col, r"(?U)(\d)\.(\d)", "$1-$2")


def without_space(col: Column) -> Column:
    """Drop all white space."""
    return F.regexp_replace(col, r"(?U)\s+", "")


def word_chars(col: Column) -> Column:
    """Letters, digits and underscore only."""
    return F.regexp_replace(col, r"\W+", "")


def alnum_only(col: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(col, r"[\W_]+", "")


def digits_only(col: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(col, r"\D+", "")


def licence_fold(col: Column) -> Column:
    """Letters O and o as zero, then letters and digits only."""
    return alnum_only(F.translate(col, "Oo", "00"))


def decode_token(token: Column) -> Column:
    """The text of one base64 token, or null if it is not valid printable base64."""
    stripped = F.when(F.length(token) % 4 == 0, F.regexp_replace(token, "={1,2}$", "")).otherwise(token)
    legal = ~F.contains(stripped, F.lit("=")) & (F.length(stripped) % 4 != 1)
    text = F.decode(F.try_to_binary(F.when(legal, stripped), F.lit("base64")), "ISO-8859-1")
    return F.when((F.length(text) > 2) & text.rlike(PRINTABLE), text)


def collapse_space(col: Column) -> Column:
    """Every run of white space as one blank."""
    wide = "\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
    plain = F.when(col.rlike(tables.char_class(wide)), F.translate(col, wide, " " * len(wide))).otherwise(col)
    return F.regexp_replace(plain, r"\s{2,}|[\t-\r]", " ")  # single blanks stay; they are most of the matches


#: a base64 token between blanks, once white space is collapsed
TOKEN = r"(?<![^ ])[A-Za-z0-9+/=]{12,}+(?![^ ])"


def token_pieces(text: Column) -> Column:
    """Base64 tokens and the text around them, in turn.  With white space collapsed a line feed is free to mark them."""
    return F.split(F.regexp_replace(text, TOKEN, "\n$0\n"), "\n")


def decode_tokens(text: Column) -> Column:
    """``text``, whose white space is collapsed, with every readable base64 token replaced by its text."""
    done = F.transform(token_pieces(text), lambda p, i: F.when(i % 2 == 1, F.coalesce(decode_token(p), p)).otherwise(p))
    return F.when(text.rlike(TOKEN), F.array_join(done, "")).otherwise(text)


def decoded_view(col: Column, rounds: int = 3) -> Column:
    """Replace base64 tokens by their text, up to three rounds; white space collapses.

    A round runs only if the one before decoded something.
    """

    def one_round(state: Column) -> Column:
        def after(text: Column) -> Column:
            return _bound(decode_tokens(text), lambda d: F.struct(d.alias("text"), (d != text).alias("changed")))

        return F.when(state["changed"], _bound(collapse_space(state["text"]), after)).otherwise(state)

    state = F.struct(col.alias("text"), F.lit(True).alias("changed"))
    for _ in range(rounds):
        state = _bound(state, one_round)
    return state["text"]


def base_view(col: Column, profile: str = "standard", nfkc: bool = False) -> Column:
    """N1-N4 chained: the text every rule reads first."""
    if profile == "spans":
        return _fold_and_drop(col, tables.span_alphabet(), tables.INVISIBLE_SPANS)
    if nfkc:
        return lookalike_fold(exact_nfkc(strip_invisible(strip_null(col))), profile)
    # Compatibility forms fold to ASCII and look-alikes are letters of other scripts, so the
    # two tables never chain and one pass does both, together with the deletions.
    table = {**tables.compatibility_chars(), **tables.lookalikes(profile)}
    return _fold_and_drop(col, table, NUL + tables.INVISIBLE)
