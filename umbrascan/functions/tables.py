"""Fixed lookup values shared by the text views.

Every value below has to equal the published behaviour for results to agree, so it
is stated as plain data.  Blocks that follow a code-point rule are generated.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

# --- fixed values -----------------------------------------------------------

# Invisible code points removed before any rule runs.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u200e\u200f\u2060\u180e\u00ad\u034f\u17b4\u17b5"
# The span profile removes only these five.
INVISIBLE_SPANS = "\u200b\u200c\u200d\u2060\ufeff"

# Cyrillic and Greek capitals and small letters drawn like Latin ones.
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "ο": "o", "ε": "e",
}
# Five Greek letters the hardened profile does not fold.
LOOKALIKE_HARDENED_MISSING = "ΙΚΜΝε"

# Letter-for-digit folding, token scoped.
LEET = {"@": "a", "4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "7": "t", "$": "s"}
# Letter-for-digit folding of the span profile, applied to every character.
LEET_SPANS = {
    "4": "a", "!": "i", "|": "i", "1": "i", "0": "o", "3": "e", "€": "e",
    "5": "s", "$": "s", "7": "t", "+": "t", "8": "b",
}
# Letters that optical recognition confuses with digits.
OCR = {
    "l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "g": "9", "G": "6",
}

# Number words, zero to nine.
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

# Alphabet folding of the span profile: each letter and its Latin reading.
SPAN_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "c", "т": "t", "у": "y", "ф": "f", "х": "x", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ъ": "soft", "ы": "y", "ь": "soft", "э": "e", "ю": "yu", "я": "ya",
    "А": "A", "Б": "B", "В": "B", "Г": "G", "Д": "D", "Е": "E", "Ж": "Zh", "З": "Z",
    "И": "I", "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "H", "О": "O", "П": "P",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ф": "F", "Х": "X", "Ц": "Ts", "Ч": "Ch",
    "Ш": "Sh", "Щ": "Shch", "Ъ": "Hard", "Ы": "Y", "Ь": "Soft", "Э": "E", "Ю": "Yu", "Я": "Ya",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "h", "θ": "th",
    "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "ch", "ψ": "ps",
    "ω": "o",
    "Α": "A", "Β": "B", "Γ": "G", "Δ": "D", "Ε": "E", "Ζ": "Z", "Η": "H", "Θ": "Th",
    "Ι": "I", "Κ": "K", "Λ": "L", "Μ": "M", "Ν": "N", "Ξ": "X", "Ο": "O", "Π": "P",
    "Ρ": "P", "Σ": "S", "Τ": "T", "Υ": "Y", "Φ": "Ph", "Χ": "X", "Ψ": "Ps", "Ω": "O",
}
LATIN_LIKE = {
    "ɑ": "a", "ɡ": "g", "ʅ": "r", "ʜ": "H", "ı": "i",
    "ſ": "s", "ℓ": "l", "№": "N",
    "ᴅ": "a", "ᴇ": "e", "ʟ": "l", "ɪ": "i", "ᴜ": "u",
    "ʏ": "y", "ᴢ": "z",
}
PUNCTUATION_LIKE = {
    "–": "-", "—": "-", "―": "-", "‒": "-", "‐": "-",
    "‑": "-", "−": "-",
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "‹": "'", "›": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
    "＿": "_", "⁄": "/", "∕": "/",
}

# --- generated tables -------------------------------------------------------


@lru_cache(maxsize=None)
def lookalikes(profile: str) -> dict[str, str]:
    """Look-alike letters folded by a type-list profile."""
    if profile == "hardened":
        return {k: v for k, v in LOOKALIKE.items() if k not in LOOKALIKE_HARDENED_MISSING}
    return dict(LOOKALIKE)


@lru_cache(maxsize=None)
def compatibility_chars() -> dict[str, str]:
    """Every character whose NFKC form is one single ASCII character."""
    table = {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        form = unicodedata.normalize("NFKC", chr(cp))
        if len(form) == 1 and " " <= form < "\x7f":
            table[chr(cp)] = form
    return table


@lru_cache(maxsize=None)
def span_alphabet() -> dict[str, str]:
    """Alphabet folding of the span profile; a few letters expand to 2-5 characters."""
    table = dict(SPAN_LETTERS)
    for first, last, ascii_first in ((0xFF10, 0xFF19, "0"), (0xFF21, 0xFF3A, "A"), (0xFF41, 0xFF5A, "a")):
        for cp in range(first, last + 1):
            table[chr(cp)] = chr(ord(ascii_first) + cp - first)
    table.update(LATIN_LIKE)
    table.update(PUNCTUATION_LIKE)
    return table


def ranges(points) -> str:
    """Code points as the inside of a character class."""
    points = sorted(set(points))
    parts, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        lo, hi = f"\\x{{{points[i]:X}}}", f"\\x{{{points[j]:X}}}"
        parts.append(lo if i == j else f"{lo}-{hi}")
        i = j + 1
    return "".join(parts)


def char_class(chars) -> str:
    """A regex class holding exactly ``chars``.

    The hull of the set comes first, per script block: ordinary letters fail on a few range
    tests and never walk the full list.
    """
    points = [ord(c) for c in chars]
    blocks = ((0, 0x20), (0x20, 0x80), (0x80, 0x100), (0x100, 0x110000))
    parts = [[p for p in points if low <= p < high] for low, high in blocks]
    hull = "".join(f"\\x{{{min(part):X}}}-\\x{{{max(part):X}}}" for part in parts if part)
    return f"[[{hull}]&&[{ranges(points)}]]"
