"""The rule catalogue: one row of plain strings per detector, compiled to Spark SQL.

A rule is data: a pattern plus optional SQL conditions in which ``{v}`` stands for the
view, ``{low}`` for the view in small letters, ``{base}`` for the base view, ``{keyword}``, ``{digit}``, ``{four}``, ``{eight}``,
``{gapped}``, ``{space}``, ``{assign}`` and ``{repairable}`` for row flags (an ID keyword, any digit, four or eight digits in a
row, four with gaps, white space, a sign with a value behind it, characters that optical repair may read as a number) and ``m``
for one match.  Patterns use
Unicode-aware classes (``(?U)``), so ``\\b \\w \\d \\s`` mean the same on any JDK.  A rule
names the views it reads; a null view equals the base view and is skipped.  ``gate`` is a
cheap necessary condition (P4): answers never depend on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions import tables



def spelled(ranges: str) -> str:
    """``A-Z`` written out: Java looks single characters up in one table, but tests the ranges of a class one by one."""
    return re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), ranges)


# --- fixed values: detector patterns ------------------------------------------

_ALNUM = spelled("A-Za-z0-9")

AADHAAR = r"\b[2-9]\d{3}[\s.-]?\d{4}[\s.-]?\d{4}\b"
AADHAAR_PREFIXED = r"\b[a-zA-Z0][2-9]\d{3}[\s.-]?\d{4}[\s.-]?\d{4}\b"
AADHAAR_SPACED = r"\b[2-9](?:\s+\d){11}\b"
# A keyword, a cue and four digits in this order on one line.  The earliest keyword and cue
# leave the most room, so atomic groups keep the search linear without losing a match.
AADHAAR_FIRST_DIGITS = (
    r"(?md)^(?>[^\n]*?(?i:aadhaar|aadhar))(?>[^\n]*?\b(?i:starts|begins|first))[^\n]*?\b([2-9]\d{3})\b"
)
AADHAAR_LAST_DIGITS = r"(?md)^(?>[^\n]*?(?i:aadhaar|aadhar))(?>[^\n]*?\b(?i:ends|last))[^\n]*?\b(\d{4})\b"
PAN = r"(?<![a-zA-Z0-9])[\.]?[a-zA-Z]{5}[\.]?[0-9]{4}[\.]?[a-zA-Z]{1}[\.]?(?![a-zA-Z0-9])"
CREDIT_CARD = r"\b(?:\d[\s-]*?){13,19}\b"
VOTER_ID = r"\b[A-Z]{3}\d{7}\b"
DRIVING_LICENSE = r"\bDL[\s-]?\d{13,15}\b"
DRIVING_LICENSE_STATE = r"\b[A-Z]{2}\d{13,15}\b"
GST = r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}Z[A-Z\d]{1}\b"
PASSPORT = r"\b[A-Z][1-9]\d{6}\b"
PASSPORT_HARDENED = r"\b[A-Z][1-9]\d{7}\b"
UPI_ID = r"\b[a-zA-Z0-9._-]+\s?@\s?[a-zA-Z]{2,6}\b(?!@)"
UPI_ID_REDACT = r"\b[a-zA-Z0-9._-]+@[a-zA-Z]{2,6}(?!@)\b"
IPV4_DIGITS = r"\d\.\d{1,3}\.\d"  # in every address
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6_TOKEN = r"\b[0-9A-Fa-f:]{2,}\b"
DATE_ISO = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_DAY_FIRST = r"\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-]\d{4}\b"
DATE_MONTH_FIRST = r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-]\d{4}\b"
DATE_MONTH_NAME = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},\s+\d{4}\b"
JWT = r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\b"
NAME_CUE = r"(?i)\b(?:my name is|customer name:|name:)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"
NAME_HONORIFIC = r"\b(?:Dr|Mr|Mrs|Ms|Miss)\.?(?:\s+[A-Z][a-z]+){1,2}\b"
NAME_TITLE_CASE = r"\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b(?!:)"
ADDRESS_CUE = (
    r"(?i)\b(?:live in|visited|send the parcel to|flat\s+\w+|street|road|residency|"
    r"bengaluru|chennai|london|new york)\b"
)
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"(?:\+91[\s-]?)[6-9]\d{4}[\s-]?\d{5}|\+\d{1,3}[\s-]\d{3,4}[\s-]\d{3,4}[\s-]\d{4}"
PHONE_IN = r"\b(?:0?91|91)?[6-9]\d{9}\b"
PHONE_US = r"\(\d{3}\)\s*\d{3}[-\s]?\d{4}|\b[2-9]\d{2}[2-9]\d{6}\b"
OPENAI_KEY = r"sk-[a-zA-Z0-9\-]{20,}"
OPENAI_KEY_HARDENED = r"sk-[a-zA-Z0-9]{20,}"
ANTHROPIC_KEY = r"sk-ant-[a-zA-Z0-9\-]{20,}"
BEARER = r"Bearer\s+[a-zA-Z0-9_\-\.]{8,}"
BEARER_HARDENED = r"Bearer\s+[a-zA-Z0-9_\-\.]{20,}"
AWS_KEY = r"AKIA[0-9A-Z]{12,16}"
AWS_KEY_HARDENED = r"AKIA[0-9A-Z]{16}"
AWS_SECRET = r"(?i)(?:aws_secret_access_key|aws_secret_key)\s*[=:]\s*[a-zA-Z0-9/+=]{40}"
AWS_SECRET_BARE = rf"\b(?=[{_ALNUM}/+=]{{40}}\b)(?=[^\n]*?[+/=])[{_ALNUM}/+=]{{40}}\b"
API_KEY = r"(?i)(?:api[_-]?key|apikey)\s*[=:]\s*[a-zA-Z0-9\-_]{12,}"
API_KEY_HARDENED = r"(?i)(?:api[_-]?key|apikey)\s*[=:]\s*[a-zA-Z0-9\-_]{16,}"
SECRET = r"(?i)(?:client_secret|secret[_-]?key|secret|password|token|auth)\s*[=:]\s*\S{8,}"
SECRET_HARDENED = r"(?i)(?:secret|password|token|auth)\s*[=:]\s*\S{8,}"
PACKED_KEY = (
    r"(?i)(?:api[_-]?key|client_secret|secret[_-]?key|secret|token)=[^=]*?"
    r"(?:sk-[a-zA-Z0-9\-]{16,}|[A-Za-z0-9/+=\-_]{12,})"
)
PACKED_SECRET = r"(?i)(?:secret|password|token|auth)(?:key)?=[^=]*?(?:[A-Za-z0-9/+=\-_]{8,})"
QUOTED_PART = r"['\"]([^'\"]+)['\"]"
QUOTED_SECRET_LABEL = r"(?i)(?:secret|password)\s*[=:]\s*['\"]"
ID_KEYWORD = r"(?i)aadhaar|aadhar|uidai"
ID_KEYWORD_SHORT = r"(?i)aadhaar|aadhar"
CARD_KEYWORD = r"(?i)\b(?:credit|debit|card|visa|mastercard|amex)\b"
ENCODED_RUN = r"[A-Za-z0-9+/]{8,}={0,2}"
# The same matches, tried only where a run begins: shorter runs are walked once, not from each of their characters.
ENCODED_RUN_FAST = rf"(?<![{_ALNUM}+/])[{_ALNUM}+/]{{8,}}+={{0,2}}+"

# Types that make a text high severity.
HIGH_STANDARD = [
    "AADHAAR", "PAN", "CREDIT_CARD", "OPENAI_KEY", "ANTHROPIC_KEY", "AWS_KEY", "AWS_SECRET", "API_KEY",
    "SECRET", "VOTER_ID", "DRIVING_LICENSE", "GST_NUMBER", "PASSPORT", "US_SSN",
]
HIGH_HARDENED = [t for t in HIGH_STANDARD if t != "US_SSN"]

# --- derived patterns -----------------------------------------------------------

PLAIN_LETTER = f"[{spelled('a-fh-km-np-rt-zA-FHJ-NP-RT-Z')}]"  # letters optical repair leaves alone
DIGIT_LIKE = f"[{spelled('0-9')}lI|OoSsgG]"  # digits and the letters read as digits
_GAP = r"[\s\-_.:]"
_EDGE = r"[^\w\s\-.:|]"  # a character that stays a word edge once gaps are dropped
AADHAAR_OCR = (
    rf"(?:^|{_EDGE}){_GAP}*+[2-9SsgG](?:{_GAP}*{DIGIT_LIKE}){{11}}{_GAP}*+(?:\z|{_EDGE})"
)
PAN_OCR_TOKEN = (
    rf"(?<!\S)[\-_.:]*+{PLAIN_LETTER}(?:[\-_.:]*{PLAIN_LETTER}){{4}}(?:[\-_.:]*{DIGIT_LIKE}){{4}}"
    rf"[\-_.:]*{PLAIN_LETTER}[\-_.:]*(?!\S)"
)
PAN_OCR_TEXT = (
    rf"(?:^|{_EDGE}){_GAP}*+{PLAIN_LETTER}(?:{_GAP}*{PLAIN_LETTER}){{4}}(?:{_GAP}*{DIGIT_LIKE}){{4}}"
    rf"{_GAP}*{PLAIN_LETTER}{_GAP}*+(?:\z|{_EDGE})"
)
PAN_REVERSED = r"(?<!\S)[a-zA-Z]\d{4}[a-zA-Z]{5}(?!\S)"
PAN_LEET = r"(?<!\S)(?=[^\d\s]{0,4}\d)[A-Za-z34105@$]{5}\d{4}[A-Za-z34105@$](?!\S)"
PAN_GAPPED = r"(?<!\S)[A-Za-z](?:\s*[A-Za-z]){4}(?:\s*\d){4}\s*[A-Za-z](?!\S)"
PAN_STEM = r"\b[a-zA-Z]{5}\d{4}\b"
SEPARATED_DIGITS = r"\d[\s\-_.]+\d"
CARD_OCR_RUN = rf"{DIGIT_LIKE}[{DIGIT_LIKE[1:-1]}\s\-_.:]{{12,}}"
FOUR_DIGIT_LIKE = rf"{DIGIT_LIKE}(?:{_GAP}*{DIGIT_LIKE}){{3}}"
OCR_NOISE = r"[lIoOsSgG|\s\-_.]"
# Any number that optical repair brings about has four characters in a row that are digits or may be read as such.  With plain
# ASCII classes, other characters counting as digits, this is a cheap necessary condition of all repaired forms.
MAYBE_FOUR_DIGITS = r"[ \t\n\x0b\f\r\-_.:]*+".join([rf"[{DIGIT_LIKE[1:-1]}B\x{{80}}-\x{{10FFFF}}]"] * 4)
# Necessary conditions with plain ASCII classes and without groups, which cost most; whatever is no letter or digit counts as a
# gap.  Both OCR forms of a PAN end a word after these, and a card number has thirteen digits.
_ANY_GAP = f"[^{_ALNUM}|]*+"
PAN_OCR_END = _ANY_GAP.join([DIGIT_LIKE] * 4 + [PLAIN_LETTER]) + f"(?![{_ALNUM}])"
THIRTEEN_DIGIT_LIKE = rf"{DIGIT_LIKE}[^{PLAIN_LETTER[1:-1]}]{{12}}"
# Row flags.  Leet and optical repair write letters and digits only, leave white space and other signs alone, and leet takes
# digits away, so a test of the base view speaks for all its views where nothing was repaired.
WHITE_SPACE = r"\s"
FOUR_DIGITS = r"\d{4}"
EIGHT_DIGITS = r"\d{4}[\s.-]?\d{4}"
GAPPED_DIGITS = r"\d[\s-]*+\d[\s-]*+\d[\s-]*+\d"
LEAST_VALUE = 8  # characters that any rule wants behind a colon or an equals sign
NON_OCR_LETTER = r"[\p{L}&&[^lIoOsSgG]]"
NUMBER_WORD = r"(?i)(?=[zotfsen])(?<!\S)(" + "|".join(tables.DIGIT_WORDS) + r")(?!\S)"
_BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
_BLANK = rf"[\s&&[^{_BREAK}]]"
KEY_ON_NEXT_LINE = (
    rf"(?i)\b(?:api[_-]?key|client_secret|secret[_-]?key|secret|token)\b{_BLANK}*[=:]?{_BLANK}*[{_BREAK}]\s*"
    rf"(?:sk-[a-zA-Z0-9\-]{{16,}}|[A-Za-z0-9/+=\-_]{{12,}}){_BLANK}*(?:[{_BREAK}]|\z)"
)


def _pan_in_two_or_three_words() -> str:
    """Five letters, four digits and a letter with one or two gaps in any place."""
    units = ["[A-Za-z]"] * 5 + [r"\d"] * 4 + ["[A-Za-z]"]
    shapes = []
    for first in range(1, 10):
        shapes.append({first})
        shapes += [{first, second} for second in range(first + 1, 10)]
    words = ["".join((r"\s+" if i in gaps else "") + u for i, u in enumerate(units)) for gaps in shapes]
    return r"(?<!\S)(?:" + "|".join(words) + r")(?!\S)"


PAN_SPLIT = _pan_in_two_or_three_words()


def u(pattern: str) -> str:
    """``pattern`` with Unicode-aware classes and ASCII case folding (text is NFKC folded)."""
    return "(?U-u)" + pattern


def quote(text: str) -> str:
    """``text`` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sees(pattern: str, subject: str = "{v}") -> str:
    return f"{subject} rlike {quote(u(pattern))}"


def has(text: str) -> str:
    return f"contains({{v}}, {quote(text)})"


def every(pattern: str, group: int = 0, subject: str = "{v}") -> str:
    return f"regexp_extract_all({subject}, {quote(u(pattern))}, {group})"


def without(pattern: str, subject: str) -> str:
    return f"regexp_replace({subject}, {quote(u(pattern))}, '')"


def once(test: str, hit: str) -> str:
    """``hit``, evaluated only where ``test`` holds, else null.

    Where an expression occurs twice, as in a gated and an ungated scan, Spark would compute the right side of ``and`` for
    every row; branches of ``if`` are left alone.
    """
    return f"if({test}, {hit}, null)"


def guarded(test: str, gate: str) -> str:
    """``gate`` as ``once`` has it, false elsewhere: after a null, Spark looks at the right side of ``and``."""
    return f"coalesce({once(test, gate)}, false)"


def dots(subject: str) -> str:
    return f"(length({subject}) - length(replace({subject}, '.', '')))"


def low(*words: str) -> str:
    """Whether one of the small-letter ``words`` occurs, in whatever case."""
    return "(" + " or ".join(f"contains({{low}}, {quote(w)})" for w in words) + ")"


# gates (P4): literals are searched byte by byte, about ten times as fast as a pattern walks the text


def sign(char: str) -> str:
    """Whether a character that is neither letter nor digit occurs, tested once for all views."""
    return f"contains({{base}}, {quote(char)})"


DIGIT = "{digit}"
FOUR = "{four}"
EIGHT = "{eight}"
GAPPED = "{gapped}"
SPACE = "{space}"
ASSIGN = "{assign}"
REPAIRABLE = "{repairable}"
KEYED_FOUR = "({keyword} and {four})"
KEYED_EIGHT = "({keyword} and {eight})"
SIGN = f"({has('=')} or {has(':')})"
DATE_SIGN = f"{FOUR} and ({sign('/')} or {sign('-')})"
MAIL_SIGN = guarded(sign("@"), has("@"))
QUOTES = f"""({sign("'")} or {sign('"')})"""
SECRET_ASSIGN = guarded(ASSIGN, low("secret", "password", "token", "auth"))
KEY_ASSIGN = guarded(ASSIGN, low("api", "secret", "token"))
FORTY_SIGNS = f"{{v}} rlike '[{_ALNUM}/+=]{{40}}'"
BASE64_SIGN = f"({sign('=')} or {sign('+')} or {sign('/')})"

# checks on one match
_CARD_DIGITS = without(r"[\s-]", "m")
LUHN_VALID = f"length({_CARD_DIGITS}) between 13 and 19 and luhn_check({_CARD_DIGITS})"
IPV4_VALID = sees(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$", "m")
# Groups of 1-4 hex digits: eight of them, or one "::" and at most seven.
_GROUPS = "filter(split(m, ':'), g -> g <> '')"
_GAPS = "(length(m) - length(replace(m, '::', ''))) div 2"
IPV6_VALID = (
    f"contains(m, ':') and not contains(m, ':::') and forall({_GROUPS}, g -> length(g) <= 4) "
    f"and {sees('^(?:[^:]|::)', 'm')} and {sees('(?:[^:]|::)$', 'm')} "
    f"and ({_GAPS} = 0 and size({_GROUPS}) = 8 or {_GAPS} = 1 and size({_GROUPS}) <= 7)"
)

# --- detectors that are more than one pattern --------------------------------------

# Each 12-digit match is judged with the white-space delimited token around it, rebuilt
# from the text pieces before and after the match.
_BEFORE = "concat(coalesce(get(s.found, i - 1), ''), get(s.pieces, i))"
_AFTER = "concat(get(s.pieces, i + 1), coalesce(get(s.found, i + 1), ''))"
_LEFT = f"regexp_extract({_BEFORE}, {quote(u(r'(\S*)\z'))}, 1)"
_RIGHT = f"regexp_extract({_AFTER}, {quote(u(r'^(\S*)'))}, 1)"
_GOES_ON = sees(r"^[\s.-]*\d", _AFTER)
# transform over a one-element array binds the matches and pieces once
_PLACED = (
    f"flatten(transform(array(named_struct('found', {every(AADHAAR)}, "
    f"'pieces', split({{v}}, {quote(u(AADHAAR))}, -1))), s -> transform(s.found, (m, i) -> named_struct("
    f"'value', m, 'token', concat({_LEFT}, m, {_RIGHT}), 'goes_on', {_GOES_ON}))))"
)
_ONE_DIGIT = sees(r"^(\d)\1*$", without(r"[\s.-]", "p.value"))
_TOKEN_DIGITS = without(r"\D", "p.token")
PLACED_AADHAAR = (
    f"transform(filter({_PLACED}, p -> not {_ONE_DIGIT} and {dots('p.token')} < 3 and ({{keyword}} or "
    f"(not p.goes_on and length({_TOKEN_DIGITS}) <= 12 and not {sees(NON_OCR_LETTER, 'p.token')}))), "
    "p -> p.value)"
)
HAS_PLACED_AADHAAR = once(sees(AADHAAR), f"size({PLACED_AADHAAR}) > 0")

_WORDS = ", ".join(quote(w) for w in tables.DIGIT_WORDS)
SPELLED_DIGITS = (
    f"array_join(transform({every(NUMBER_WORD, 1)}, w -> cast(array_position(array({_WORDS}), lower(w)) - 1 "
    "as string)), '') rlike '[2-9][0-9]{11}'"
)
OCR_AADHAAR = (
    f"({{keyword}} or (not {sees(NON_OCR_LETTER)} and {sees(OCR_NOISE)} and {dots('{v}')} < 3)) and {sees(AADHAAR_OCR)}"
)
OCR_PAN = f"{sees(OCR_NOISE)} and ({sees(PAN_OCR_TOKEN)} or {sees(PAN_OCR_TEXT)})"
_OCR_KEYS, _OCR_VALUES = quote("".join(tables.OCR)), quote("".join(tables.OCR.values()))
_OCR_NUMBERS = (
    f"flatten(transform({every(CARD_OCR_RUN)}, r -> regexp_extract_all(translate("
    f"{without(_GAP + '+', 'r')}, {_OCR_KEYS}, {_OCR_VALUES}), '[0-9]{{13,19}}', 0)))"
)
# ``exists(array(x), y -> ...)`` binds x once.  It also keeps x out of common-subexpression
# elimination, which would compute it for every row, before the cheap tests.
OCR_CARD = (
    f"{sees(CARD_OCR_RUN)} and exists(array({_OCR_NUMBERS}), ns -> exists(ns, n -> luhn_check(n)) or "
    f"(size(ns) > 0 and {sees(CARD_KEYWORD)} and {sees(SEPARATED_DIGITS)})) and {sees(OCR_NOISE)}"
)
# Loose shape first, the exact list of shapes only where it matched.
SPLIT_PAN = once(sees(PAN_GAPPED), sees(PAN_SPLIT))
_PARTS = every(QUOTED_PART, 1)
# The joined parts start with "sk-", so the first quoted part gives a cheap test.
_FIRST_PART = sees(r"""^[^'"]*['"]+s(?:['"]|k(?:['"]|-))""")
QUOTED_KEY = (
    f"{_FIRST_PART} and exists(array({_PARTS}), p -> size(p) >= 2 and array_join(p, '') "
    "rlike '^sk-[a-zA-Z0-9]{20,}')"
)
QUOTED_SECRET = (
    f"{sees(QUOTED_SECRET_LABEL)} and exists(array({_PARTS}), p -> size(p) >= 2 and length(array_join(p, '')) >= 8)"
)
SHORT_KEYWORD = sees(ID_KEYWORD_SHORT)
# Twelve number words need one that is neither "zero" nor "one"; the gate counts occurrences in whatever place.
_COUNTED = [w for w in tables.DIGIT_WORDS if w not in ("zero", "one")]
_COUNTS = [f"(octet_length({{low}}) - octet_length(replace({{low}}, {quote(w)}, ''))) div {len(w)}" for w in tables.DIGIT_WORDS]
NUMBER_WORDS = f"{SPACE} and {' + '.join(_COUNTS)} >= 12"
_LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NEXT_LINE_LABEL = f"{low('key', 'secret', 'token')} and " + sees(rf"(?i)(?:key|secret|token)[\s=:]*{_LINE_END}")
NAME_WORD = f"{SPACE} and {low('name')}"
HONORIFIC = f"{SPACE} and (" + " or ".join(has(w) for w in ("Dr", "Mr", "Ms", "Miss")) + ")"
# Two capitalized words in a row, without word edges and with ASCII classes: the pattern proper runs where this matches.
TITLE_PAIR = f"{SPACE} and {{v}} rlike {quote(r'[A-Z][a-z]{2,}[^!-~]+[A-Z][a-z]')}"
ADDRESS_WORDS = [
    "live in", "visited", "send the parcel to", "flat", "street", "road", "residency", "bengaluru", "chennai", "london", "new york",
]
_BLANK_WORDS = [w for w in ADDRESS_WORDS if " " in w or w == "flat"]  # a word follows "flat"
PLACE_WORD = f"({low(*[w for w in ADDRESS_WORDS if w not in _BLANK_WORDS])} or {SPACE} and {low(*_BLANK_WORDS)})"


# --- rules ------------------------------------------------------------------------

TEXT = ("base", "leet")
NUMBER = ("base", "leet", "ocr")


@dataclass(frozen=True)
class Rule:
    """One detector.  ``pattern`` finds candidates, ``accept`` keeps the valid matches,
    ``context`` is a condition on the whole row; ``test`` and ``find`` replace the pattern
    test and extraction for detectors that are not one regular expression."""

    rule_id: str
    type: str
    pattern: str | None = None
    views: tuple[str, ...] = TEXT
    gate: str | None = None
    accept: str | None = None
    context: str | None = None
    test: str | None = None
    find: str | None = None
    group: int = 0
    also: str | None = None  # a second type reported together with ``type``

    @property
    def types(self) -> tuple[str, ...]:
        return (self.type, self.also) if self.also else (self.type,)

    def _candidates(self) -> str:
        return self.find or every(self.pattern, self.group)

    def condition(self, view: str, refs: dict[str, str], prefilter: bool = True) -> str:
        """SQL that is true if the rule fires in one view; null if that view is null."""
        if self.test:
            hit = self.test
        elif self.accept:
            hit = f"exists({self._candidates()}, m -> {self.accept})"
        else:
            hit = sees(self.pattern)
        gates = [self.gate] if prefilter and self.gate else []
        contexts = [self.context] if self.context else []
        return _fill("(" + " and ".join([*gates, *contexts, hit]) + ")", view, refs)

    def fires(self, refs: dict[str, str], prefilter: bool = True) -> str:
        """SQL that is true if the rule fires in any of its views; never null."""
        hits = [f"coalesce({self.condition(v, refs, prefilter)}, false)" for v in self.views if v in refs]
        return "(" + " or ".join(hits) + ")"

    def matches(self, view: str, refs: dict[str, str]) -> str | None:
        """SQL array of every accepted match in one view; none for whole-text detectors."""
        if not self.find and not self.pattern:
            return None
        found = self._candidates()
        if self.accept:
            found = f"filter({found}, m -> {self.accept})"
        if self.context:
            found = f"if({self.context}, {found}, cast(array() as array<string>))"
        return _fill(found, view, refs)


def _fill(sql: str, view: str, refs: dict[str, str]) -> str:
    small = refs.get(f"low_{view}", f"lower({refs[view]})")
    sql = sql.replace("{v}", refs[view]).replace("{low}", small).replace("{keyword}", refs.get("id_keyword", "false"))
    sql = sql.replace("{base}", refs["base"])
    for flag in ("digit", "four", "eight", "gapped", "space", "assign", "repairable"):
        sql = sql.replace(f"{{{flag}}}", refs.get(flag, "true"))
    return sql


STANDARD_RULES: list[Rule] = [
    Rule("aadhaar", "AADHAAR", AADHAAR, NUMBER, EIGHT, test=HAS_PLACED_AADHAAR, find=PLACED_AADHAAR),
    Rule("aadhaar_prefixed", "AADHAAR", AADHAAR_PREFIXED, NUMBER, EIGHT),
    Rule("aadhaar_words", "AADHAAR", views=TEXT, gate=NUMBER_WORDS, test=SPELLED_DIGITS),
    Rule("aadhaar_spaced", "AADHAAR", AADHAAR_SPACED, NUMBER, f"{SPACE} and {GAPPED}"),
    Rule("aadhaar_embedded", "AADHAAR", r"[2-9]\d{11}", NUMBER, KEYED_EIGHT, context=SHORT_KEYWORD),
    Rule("aadhaar_first_digits", "AADHAAR", AADHAAR_FIRST_DIGITS, NUMBER, KEYED_FOUR, group=1),
    Rule("aadhaar_last_digits", "AADHAAR", AADHAAR_LAST_DIGITS, NUMBER, KEYED_FOUR, group=1),
    Rule("aadhaar_ocr", "AADHAAR", views=("base",), gate=REPAIRABLE, test=OCR_AADHAAR),
    Rule("pan", "PAN", PAN, TEXT, FOUR),
    Rule("pan_ocr", "PAN", views=("base",), gate=f"{REPAIRABLE} and {{v}} rlike {quote(PAN_OCR_END)}", test=OCR_PAN),
    Rule("pan_reversed", "PAN", PAN_REVERSED, TEXT, FOUR),
    Rule("pan_leet", "PAN", PAN_LEET, ("base",), FOUR),
    Rule("pan_split", "PAN", views=TEXT, gate=f"{SPACE} and {GAPPED}", test=SPLIT_PAN),
    Rule("pan_incomplete", "PAN", PAN_STEM, TEXT, FOUR, context=sees(r"(?i)\bpan\b")),
    Rule("credit_card", "CREDIT_CARD", CREDIT_CARD, NUMBER, GAPPED, LUHN_VALID),
    Rule("credit_card_ocr", "CREDIT_CARD", views=("base",), gate=f"{REPAIRABLE} and {{v}} rlike {quote(THIRTEEN_DIGIT_LIKE)}", test=OCR_CARD),
    Rule("voter_id", "VOTER_ID", VOTER_ID, NUMBER, FOUR),
    Rule("driving_license", "DRIVING_LICENSE", DRIVING_LICENSE, NUMBER, f"{EIGHT} and {has('DL')}"),
    Rule("driving_license_state", "DRIVING_LICENSE", DRIVING_LICENSE_STATE, NUMBER, EIGHT),
    Rule("gst", "GST_NUMBER", GST, NUMBER, FOUR, context="not " + sees(r"ZZ\b")),
    Rule("passport", "PASSPORT", PASSPORT, NUMBER, FOUR),
    Rule("us_ssn", "US_SSN", SSN, NUMBER, f"{FOUR} and {sign('-')}"),
    Rule("email", "EMAIL_ADDRESS", EMAIL, TEXT, MAIL_SIGN),
    Rule("phone_country_code", "PHONE_NUMBER", PHONE, NUMBER, sign("+")),
    Rule("phone_in", "PHONE_NUMBER", PHONE_IN, NUMBER, EIGHT),
    Rule("phone_us", "PHONE_NUMBER", PHONE_US, NUMBER, FOUR),
    Rule("ipv4", "IP4", IPV4, NUMBER, f"{DIGIT} and {sign('.')} and {sees(IPV4_DIGITS)}", IPV4_VALID),
    Rule("ipv6", "IP6", IPV6_TOKEN, TEXT, f"{sign(':')} and {sees(':[0-9A-Fa-f]*:')}", IPV6_VALID),
    Rule("date_iso", "DATE", DATE_ISO, NUMBER, f"{FOUR} and {sign('-')}"),
    Rule("date_day_first", "DATE", DATE_DAY_FIRST, NUMBER, DATE_SIGN),
    Rule("date_month_first", "DATE", DATE_MONTH_FIRST, NUMBER, DATE_SIGN),
    Rule("date_month_name", "DATE", DATE_MONTH_NAME, NUMBER, f"{SPACE} and {FOUR} and {sign(',')}"),
    Rule("upi", "UPI_ID", UPI_ID, TEXT, MAIL_SIGN),
    Rule("jwt", "JWT", JWT, TEXT, f"{sign('.')} and {has('eyJ')}"),
    Rule("name_cue", "PERSON", NAME_CUE, TEXT, NAME_WORD),
    Rule("name_honorific", "PERSON", NAME_HONORIFIC, TEXT, HONORIFIC),
    Rule("name_title_case", "PERSON", NAME_TITLE_CASE, TEXT, TITLE_PAIR),
    Rule("address_cue", "LOCATION", ADDRESS_CUE, TEXT, PLACE_WORD),
    Rule("openai_key", "OPENAI_KEY", OPENAI_KEY, TEXT, f"{sign('-')} and {has('sk-')}"),
    Rule("anthropic_key", "ANTHROPIC_KEY", ANTHROPIC_KEY, TEXT, f"{sign('-')} and {has('sk-ant-')}"),
    Rule("bearer_token", "BEARER_TOKEN", BEARER, TEXT, f"{SPACE} and {has('Bearer')}"),
    Rule("aws_key", "AWS_KEY", AWS_KEY, TEXT, has("AKIA")),
    Rule("aws_secret", "AWS_SECRET", AWS_SECRET, TEXT, guarded(ASSIGN, low("aws_secret"))),
    Rule("aws_secret_bare", "AWS_SECRET", AWS_SECRET_BARE, TEXT, f"{BASE64_SIGN} and {FORTY_SIGNS}"),
    Rule("generic_api_key", "GENERIC_API_KEY", API_KEY, TEXT, guarded(ASSIGN, low("api"))),
    Rule("generic_secret", "GENERIC_SECRET", SECRET, TEXT, SECRET_ASSIGN),
]
# A key that only appears once its parts are joined counts as a key and as a secret.
STANDARD_RULES += [
    Rule("split_key_quoted", "OPENAI_KEY", views=TEXT, gate=QUOTES, test=QUOTED_KEY, also="SECRET"),
    Rule("split_key_packed", "OPENAI_KEY", PACKED_KEY, ("packed",), KEY_ASSIGN, also="SECRET"),
    Rule("split_key_next_line", "OPENAI_KEY", KEY_ON_NEXT_LINE, TEXT, NEXT_LINE_LABEL, also="SECRET"),
    Rule("split_secret_quoted", "SECRET", views=TEXT, gate=guarded(QUOTES, low("secret", "password")), test=QUOTED_SECRET),
    Rule("split_secret_packed", "SECRET", PACKED_SECRET, ("packed",), SECRET_ASSIGN),
]

BASE = ("base",)
HARDENED_RULES: list[Rule] = [
    Rule("aadhaar", "AADHAAR", AADHAAR, BASE, DIGIT),
    Rule("aadhaar_prefixed", "AADHAAR", AADHAAR_PREFIXED, BASE, DIGIT),
    Rule("pan", "PAN", PAN, BASE, DIGIT),
    Rule("credit_card", "CREDIT_CARD", CREDIT_CARD, BASE, DIGIT, LUHN_VALID),
    Rule("voter_id", "VOTER_ID", VOTER_ID, BASE, DIGIT),
    Rule("driving_license", "DRIVING_LICENSE", DRIVING_LICENSE, BASE, DIGIT),
    Rule("gst", "GST_NUMBER", GST, BASE, DIGIT),
    Rule("passport", "PASSPORT", PASSPORT_HARDENED, BASE, DIGIT),
    Rule("openai_key", "OPENAI_KEY", OPENAI_KEY_HARDENED, BASE, has("sk-")),
    Rule("anthropic_key", "ANTHROPIC_KEY", ANTHROPIC_KEY, BASE, has("sk-ant-")),
    Rule("bearer_token", "BEARER_TOKEN", BEARER_HARDENED, BASE, has("Bearer")),
    Rule("aws_key", "AWS_KEY", AWS_KEY_HARDENED, BASE, has("AKIA")),
    Rule("aws_secret", "AWS_SECRET", AWS_SECRET, BASE, SIGN),
    Rule("generic_api_key", "GENERIC_API_KEY", API_KEY_HARDENED, BASE, SIGN),
    Rule("generic_secret", "GENERIC_SECRET", SECRET_HARDENED, BASE, SIGN),
]


# What a decoded text must hold for any rule of the catalogue to fire in any of its views.  Without a digit or one of the
# signs the leet and packed views equal the text, so the other parts need to look at the text alone.
WORTH_SCANNING = "|".join(
    [
        r"[\p{Nd}@$+=:/'\"]",
        MAYBE_FOUR_DIGITS,
        "eyJ|sk-|Bearer|AKIA|Dr|Mr|Ms|Miss",
        r"[A-Z][a-z]{2,}\s+[A-Z]",
        "(?i:" + "|".join([*_COUNTED, "name", "aadha", "uidai", *ADDRESS_WORDS]) + ")",
        rf"(?i:key|secret|token)[\s=:]*{_LINE_END}",
    ]
)


@dataclass(frozen=True)
class Profile:
    """A rule set with its severity policy and base64 limits."""

    name: str
    rules: tuple[Rule, ...]
    high_types: tuple[str, ...]
    encoded_blocks: bool  # do BASE64_* findings block?
    min_decoded: int  # shortest decoded text that is scanned

    def with_rules(self, *extra: Rule) -> Profile:
        """The same profile with more rule rows."""
        return Profile(self.name, self.rules + extra, self.high_types, self.encoded_blocks, self.min_decoded)

    def without(self, *rule_ids: str) -> Profile:
        """The same profile with some rules switched off, e.g. the broad name rule."""
        kept = tuple(r for r in self.rules if r.rule_id not in rule_ids)
        return Profile(self.name, kept, self.high_types, self.encoded_blocks, self.min_decoded)

    @property
    def types(self) -> list[str]:
        return sorted({t for r in self.rules for t in r.types})

    @property
    def worth_scanning(self) -> str | None:
        """A necessary pattern of texts in which a rule can fire; none if there are rules that are not in the catalogue."""
        return u(WORTH_SCANNING) if set(self.rules) <= {*STANDARD_RULES, *HARDENED_RULES} else None


PROFILES = {
    "standard": Profile("standard", tuple(STANDARD_RULES), tuple(HIGH_STANDARD), False, 4),
    "hardened": Profile("hardened", tuple(HARDENED_RULES), tuple(HIGH_HARDENED), True, 6),
}


def profile_of(profile: str | Profile) -> Profile:
    return PROFILES[profile] if isinstance(profile, str) else profile
