"""Pre-tokens: pieces of a text that a tokenizer merges separately.

Texts whose characters all lie below U+0300 are split by the standard library's ``re`` with explicit character
classes, which gives the same pieces as the property classes about four times as fast.  All other texts go through
the property classes, or through the tokenizer's own splitter.
"""

from __future__ import annotations

import re
import sys
from array import array

import regex

#: bytes of a cache entry besides the characters of its key and value: two objects and their place in the table
ENTRY = 110
LATIN_END = "̀"


def _ranges(prop: str) -> str:
    """Characters below U+0300 with a property, as the inside of a character class."""
    points = [i for i in range(ord(LATIN_END)) if regex.fullmatch(prop, chr(i))]
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


_CLASSES = {r"\p{L}": _ranges(r"\p{L}"), r"\p{N}": _ranges(r"\p{N}"), r"\s": _ranges(r"\p{White_Space}")}


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0300, with its property classes spelled out."""
    bare = re.sub(r"(?<!\[)(?<!\[\^)(?<!s)(?<!})(\\p\{[LN]\}|\\s)", lambda m: f"[{m[1]}]", pattern)
    bare = re.sub(r"\[\[([^\]]*)\]\]", r"[\1]", bare).replace(r"\S", rf"[^{_CLASSES[chr(92) + 's']}]")
    for name, chars in _CLASSES.items():
        bare = bare.replace(name, chars)
    return re.compile(bare)


_BEYOND = re.compile(f"[{LATIN_END}-\U0010ffff]").search


def is_latin(text: str) -> bool:
    """Whether all characters lie below U+0300."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _BEYOND(text)


class Splitter:
    """``split(text)`` gives the matches of ``pattern``."""

    def __init__(self, pattern: str):
        self._latin = latin_pattern(pattern).findall
        self._any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def split(self, text: str) -> list[str]:
        return self._latin(text) if is_latin(text) else self._any(text)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others are numbered from U+0100."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


LETTERS = byte_letters()
SPACE = LETTERS[32]


def spelled(piece: str) -> str:
    if piece.isascii() and (word := piece[1:]).isalpha() and piece[0] == " ":
        return SPACE + word
    return piece.encode().decode("latin-1").translate(LETTERS)


class Cache(dict):
    """Values made by ``make(key)`` when first asked for; of two generations the older is dropped when the younger is full.

    ``room`` bounds the bytes of a generation, so a cache holds at most twice as much.
    """

    def __init__(self, make, room: int):
        self.make, self.room, self.left, self.older = make, room, room, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        self.left -= ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.left < 0:
            self.older = dict(self)
            self.clear()
            self.left = self.room
        self[key] = value
        return value


class _Joined(Exception):
    """A chunk between spaces that starts or ends with other white space."""


class LibraryIds:
    """Token ids of a byte-level ``tokenizers`` file, packed little-endian.

    The library merges each distinct pre-token once and keeps the result in a cache of bounded size: the same ids as
    encoding whole texts, as byte-level merges never cross pre-tokens.  A single space between two other characters
    always starts a pre-token, so texts are first cut there and whole chunks are cached too; texts with longer runs of
    white space around spaces are cut by the pattern alone.  Special tokens of the file are cut out first, as the
    library does.
    """

    def __init__(self, path: str, pattern: str, room: int = 130 << 20):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.vocab_size = tok.get_vocab_size(True)
        self.code = "H" if self.vocab_size <= 1 << 16 else "I"
        self.kind = {"H": "<u2", "I": "<u4"}[self.code]
        self.special = {t.content: array(self.code, [i]).tobytes() for i, t in tok.get_added_tokens_decoder().items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._first = sorted({t[0] for t in self.special})
        self._latin = latin_pattern(pattern).findall
        self._pre, self._model = tok.pre_tokenizer, tok.model
        self._raw = Cache(lambda p: self._merge(spelled(p)), room // 5)
        self._other = Cache(self._merge, room // 8)
        self._chunks = Cache(self._chunk, room)

    def _merge(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Joined
        # long pieces are cached with their chunk, or not at all: most of them come in one chunk only
        return b"".join([self._raw[p] if len(p) < 4 else self._merge(spelled(p)) for p in self._latin(" " + chunk)])

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._raw.__getitem__, self._latin(text)))

    def _plain(self, text: str) -> bytes:
        if not is_latin(text):
            return b"".join(self._other[p] for p, _ in self._pre.pre_tokenize_str(text))
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._pieces(text)
        try:
            return self._pieces(first) + b"".join(map(self._chunks.__getitem__, rest))
        except _Joined:
            return self._pieces(text)

    def packed(self, text: str) -> bytes:
        if any(c in text for c in self._first) and any(s in text for s in self.special):
            return b"".join(self.special.get(p) or self._plain(p) for p in self._cut.split(text))
        return self._plain(text)


def once(key, make):
    """A worker's own object, made when first asked for and kept for later tasks of the same operator.

    Objects are kept outside this package, whose functions are sent by value.  ``key`` starts with the operator's name; the
    first object of another operator drops all that are held, as a worker lives on through the stages of a job.
    """
    held = vars(sys).setdefault("llm_worker_objects", {})
    if key not in held:
        if any(k[0] != key[0] for k in held):
            held.clear()
        held[key] = make()
    return held[key]
