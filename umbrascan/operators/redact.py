"""Redaction as a chain of native replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import views as V
from . import rules as R
from .rules import Profile, profile_of, u

TOKEN = "[REDACTED]"

_GROUP = "[0-9A-Fa-f]{1,4}"
# A written-out address, or one "::" with at most seven groups around it.
IPV6_ADDRESS = (
    r"(?<![\w:])(?:"
    + "|".join(
        [rf"(?:{_GROUP}:){{7}}{_GROUP}"]
        + [rf"(?:{_GROUP}:){{1,{7 - n}}}(?::{_GROUP}){{1,{n}}}" for n in range(1, 7)]
        + [rf"(?:{_GROUP}:){{1,7}}:", rf":(?::{_GROUP}){{1,7}}"]
    )
    + r")(?![\w:])"
)

# Replacement order matters: an earlier pattern hides text from a later one.
REFERENCE_CHAIN = [
    R.AADHAAR, R.PAN, R.CREDIT_CARD, R.UPI_ID_REDACT, R.IPV4, IPV6_ADDRESS,
    R.DATE_ISO, R.DATE_DAY_FIRST, R.DATE_MONTH_FIRST, R.DATE_MONTH_NAME, R.JWT, R.NAME_CUE, R.ADDRESS_CUE,
]
# These are matched regardless of case.
REFERENCE_KEYS = [R.OPENAI_KEY, R.ANTHROPIC_KEY, R.BEARER, R.AWS_KEY, R.AWS_SECRET, R.API_KEY, R.SECRET]
HARDENED_CHAIN = [R.AADHAAR, R.PAN, R.CREDIT_CARD]
# With full coverage the long shapes go first, so that a shorter pattern cannot take a part of
# a card number or of an e-mail address and leave the rest.
_CARD_LIKE = rf"(?<!\w)(?=[lI|OoSsgG\s\-_.:]{{0,40}}[0-9]){R.DIGIT_LIKE}(?:[\s\-_.:]?{R.DIGIT_LIKE}){{12,18}}(?!\w)"
LEADING_CHAIN = [R.EMAIL, R.CREDIT_CARD, _CARD_LIKE]
# Types the reference chain detects but leaves in place.
COMPLETING_CHAIN = [
    rf"(?<!\w)(?=[lI|OoSsgG\s.-]{{0,24}}[0-9])[2-9SsgG](?:[\s.-]?{R.DIGIT_LIKE}){{11}}(?!\w)",
    rf"(?<!\w){R.PLAIN_LETTER}(?:[\s\-_.:]?{R.PLAIN_LETTER}){{4}}(?:[\s\-_.:]?{R.DIGIT_LIKE}){{4}}[\s\-_.:]?{R.PLAIN_LETTER}(?!\w)",
    R.AADHAAR_PREFIXED, R.AADHAAR_SPACED, R.PAN_REVERSED, R.PAN_LEET, R.PAN_SPLIT, R.PAN_OCR_TOKEN,
    R.GST, R.DRIVING_LICENSE, R.DRIVING_LICENSE_STATE, R.VOTER_ID, R.PASSPORT, R.SSN, R.EMAIL, R.UPI_ID,
    R.PHONE, R.PHONE_IN, R.PHONE_US, R.KEY_ON_NEXT_LINE, R.NAME_HONORIFIC, R.NAME_TITLE_CASE,
]


def chain(profile: str | Profile = "standard", coverage: str = "all") -> list[str]:
    """The patterns replaced for ``profile``, in order."""
    if coverage not in ("all", "reference"):
        raise ValueError(f"unknown coverage {coverage!r}")
    if profile_of(profile).name == "hardened" and coverage == "reference":
        return [u(p) for p in HARDENED_CHAIN]
    patterns = [u(p) for p in LEADING_CHAIN] if coverage == "all" else []
    patterns += [u(p) for p in REFERENCE_CHAIN]
    patterns += ["(?i)" + u(p) for p in REFERENCE_KEYS]
    patterns += [u(R.AWS_SECRET_BARE)]
    if coverage == "all":
        patterns += [u(p) for p in COMPLETING_CHAIN]
    return patterns


def redacted(base: Column, profile: str | Profile = "standard", coverage: str = "all") -> Column:
    """``base`` with every covered match replaced by one token.

    ``coverage="reference"`` keeps to the patterns of the reference chain;
    ``"all"`` also removes the types that chain leaves in place.  Callers wrap the result
    in ``when(flag, ...)``, so clean rows never run the chain.
    """
    out = base
    for pattern in chain(profile, coverage):
        out = F.regexp_replace(out, pattern, TOKEN)
    return out


def redact(
    df: DataFrame,
    text_col: str,
    flag: str,
    profile: str | Profile = "standard",
    coverage: str = "all",
    out_col: str = "redacted_text",
) -> DataFrame:
    """Flagged rows get redacted text, clean rows keep their text unchanged."""
    base = V.base_view(F.coalesce(F.col(text_col), F.lit("")), profile_of(profile).name)
    if profile_of(profile).name == "hardened":
        base = V.dot_to_dash(base)
    return df.withColumn(out_col, F.when(F.col(flag), redacted(base, profile, coverage)).otherwise(F.col(text_col)))
