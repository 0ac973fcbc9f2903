"""The span profile: hits with values and offsets over four views, typed redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import positions
from ..functions import views as V
from . import decide
from .rules import quote
from .scan import settled

# --- fixed values: span patterns, in matching order -----------------------------
PATTERNS = [
    ("AADHAAR", r"\b\d{3,4}[\s.\-_/—–]{0,3}\d{4}[\s.\-_/—–]{0,3}\d{4}\b"),
    ("PAN", r"(?i)(?<![a-zA-Z0-9])[\.]?[a-zA-Z]{5}[\. \-_]?[0-9]{4}[\. \-_]?[a-zA-Z]{1}[\.]?(?![a-zA-Z0-9])"),
    ("DRIVING_LICENSE", r"\b[A-Z]{2}[\s.\-_/—–]?\d{2}[\s.\-_/—–]?\d{4}[\s.\-_/—–]?\d{7}\b"),
    ("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}[Z]{1}[A-Z\d]{1}\b"),
    ("PASSPORT_IN", r"\b[A-PR-WYa-pr-wy][1-9]\d[\s]?\d{4}[1-9]\b"),
    ("EMAIL", r"""(?:"[^"]*"|\([^)]*\)|[A-Za-z0-9._%+-]+)@[A-Za-z0-9.-]+\.[A-Za-z0-9]{2,}"""),
    (
        "UPI",
        r"(?i)\b[\w.\-+]{2,}@(okicici|okhdfcbank|okhdfc|okicci|oksbi|okaxis|okbob|ybl|paytm|icici|icicibank|hdfc|"
        r"hdfcbank|bob|upi|kvb|dbs|federal|axis|axisbank|pnb|canara|indianbank|unionbank|iob|karurvyasa|city|"
        r"standardchartered|kotak|kotakbank|yesbank|yes|googlepay|gpay|phonepe|amazonpay|msidbi|jio|airtel|vi|bsnl)\b",
    ),
    ("CREDIT_CARD", r"\b(?:\d[\s.\-—–/]*?){13,16}\b"),
    ("API_KEY", r"\b(?:sk|pk|rk)_[A-Za-z0-9]{20,}\b|\bAKIA[0-9A-Z]{16}\b"),
    ("PHONE_IN", r"(?:\(?\+?91\)?[\s.\-]?)?(?:\(?0\))?[\s.\-]?[6-9]\d{4}[\s.\-]?\d{5}"),
]
FALLBACK_PHONE = "(?:91|0091)?([6-9][0-9]{9})"
FALLBACK_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9]{2,}"
LETTERS = r"[a-zA-Z\x{400}-\x{4FF}\x{370}-\x{3FF}]"
MARKER = "evasion-normalized: "

# Five letters, four digits, a letter; two letters and thirteen digits (O counts as zero):
# in both cases anything but ASCII letters and digits may stand between.
_X = "[^A-Za-z0-9]*"
FOUR_GAPPED_DIGITS = f"[0-9](?:{_X}[0-9]){{3}}"
GAPPED_PAN = f"[A-Za-z](?:{_X}[A-Za-z]){{4}}(?:{_X}[0-9]){{4}}{_X}[A-Za-z]"
THIRTEEN_GAPPED_DIGITS = f"[0-9Oo](?:{_X}[0-9Oo]){{12}}"
GAPPED_LICENCE = f"[A-NP-Za-np-z]{_X}[A-NP-Za-np-z](?:{_X}[0-9Oo]){{13}}"

_NAME = "[A-Za-z0-9._%+-]"
#: how a gapped PAN ends; sought from its digits, which are rarer than letters
_PAN_END = f"{FOUR_GAPPED_DIGITS}{_X}[A-Za-z]"
#: a PAN and a licence once the gaps are gone; the first of them begins where the first gapped one does
_PLAIN_PAN = "[0-9](?<=[A-Za-z]{5}[0-9])[0-9]{3}[A-Za-z]"
_PLAIN_LICENCE = "[A-NP-Za-np-z]{2}[0-9Oo]{13}"

VIEWS = ["folded", "leet", "decoded", "compact"]
_WORD = "[A-Za-z0-9_]"
_HIT = "struct<type:string,value:string,ord:int,start:int,end:int>"
_NONE = f"cast(array() as array<{_HIT}>)"


def linear(pattern: str) -> str:
    """The same matches without walking a gap or a run of characters again from each place in it.

    What follows a gap, or the name of a mail address, is never a part of it, so neither has to give characters back.  The
    first match that begins inside a run begins where the run does, or where the match before it ended.
    """
    pattern = pattern.replace(_X, _X + "+")
    return re.sub(re.escape(f"{_NAME}+") + r"(?=\)?@)", lambda _: rf"(?:\G|(?<!{_NAME})){_NAME}++", pattern)


def ascii_classes(pattern: str) -> str:
    r"""Give ``\b`` its ASCII meaning and ``\s`` the ECMAScript one, on any JDK.

    A ``\b`` that opens an alternative faces a word character, one that closes it follows one.
    """
    pattern = re.sub(r"(^|\(\?i\)|\|)\\b(?!\[\\w)", rf"\1(?<!{_WORD})", pattern)
    pattern = re.sub(r"\\b($|\|)", rf"(?!{_WORD})\1", pattern)
    edge = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    return pattern.replace(r"\b", edge).replace(r"\s", V.WIDE_SPACE[1:-1])


COMPILED = [(t, linear(ascii_classes(p))) for t, p in PATTERNS]
_GATE = {"EMAIL": "contains({v}, '@')", "UPI": "contains({v}, '@')", "API_KEY": "(contains({v}, 'k_') or contains({v}, 'AKIA'))"}


def _hit(type_: str, value: str, ord_: int, start: str = "null", end: str = "null") -> str:
    return (
        f"named_struct('type', {quote(type_)}, 'value', {value}, 'ord', {ord_}, "
        f"'start', cast({start} as int), 'end', cast({end} as int))"
    )


def _pattern_hits(type_: str, pattern: str, ord_: int, view: str) -> str:
    """Every match with its offset; text pieces between matches give the positions."""
    literal = quote(pattern)
    pairs = (
        f"zip_with(split({view}, {literal}, -1), regexp_extract_all({view}, {literal}, 0), "
        "(p, m) -> named_struct('gap', length(p), 'm', m))"
    )
    start = "acc.pos + z.gap"
    step = (
        f"if(z.m is null, acc, named_struct('pos', {start} + length(z.m), 'hits', concat(acc.hits, array("
        f"{_hit(type_, 'z.m', ord_, start, f'{start} + length(z.m)')}))))"
    )
    walk = f"aggregate({pairs}, named_struct('pos', 0, 'hits', {_NONE}), (acc, z) -> {step}, acc -> acc.hits)"
    gate = _GATE.get(type_, "{v}_digit")
    return f"if({gate.replace('{v}', view)} and {view} rlike {literal}, {walk}, {_NONE})"


def _fallback_hits(view: str, hits: str, base: int) -> str:
    """Findings on reduced texts, only for types without a direct hit in this view."""
    digits = f"{view}_digits"
    joined = f"regexp_replace({view}, {quote(V.WIDE_SPACE)}, '')"
    # PAN and licence are sought without gaps, in texts whose digits may belong to one: walking the gaps from every letter
    # takes some fifty times as long.  ``exists`` keeps the text without gaps out of common-subexpression elimination,
    # which would make it for every row.
    plain = f"regexp_replace({view}, '[^A-Za-z0-9]+', '')"
    pan = f"regexp_extract({plain}, '[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z]', 0)"
    licence = f"regexp_extract({plain}, {quote(_PLAIN_LICENCE)}, 0)"
    mail = quote(linear(FALLBACK_EMAIL))
    rows = [
        ("AADHAAR", f"length({digits}) = 12", digits),
        ("PAN", f"{view}_digit and {view} rlike {quote(linear(_PAN_END))} and exists(array({plain}), p -> p rlike {quote(_PLAIN_PAN)})", f"upper({pan})"),
        (
            "PHONE_IN",
            f"{view}_digit and not {view} rlike {quote(LETTERS)} and {digits} rlike {quote(FALLBACK_PHONE)}",
            f"regexp_extract({digits}, {quote(FALLBACK_PHONE)}, 0)",
        ),
        (
            "DRIVING_LICENSE",
            f"{view} rlike {quote(linear(THIRTEEN_GAPPED_DIGITS))} and exists(array({plain}), p -> p rlike {quote(_PLAIN_LICENCE)})",
            f"upper(translate({licence}, 'Oo', '00'))",
        ),
        (
            "EMAIL",
            f"contains({view}, '@') and {joined} rlike {mail}",
            f"regexp_extract({joined}, {mail}, 0)",
        ),
    ]
    parts = [
        f"if({cond} and not exists({hits}, h -> h.type = '{t}'), array({_hit(t, value, base + i)}), {_NONE})"
        for i, (t, cond, value) in enumerate(rows)
    ]
    return f"concat({', '.join(parts)})"


def with_span_views(df: DataFrame, text_col: str) -> DataFrame:
    """The four views: folded, leet, decoded and compact."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.withColumn("__folded", V.base_view(raw, "spans"))
    out = out.withColumn("__leet", V.leet_fold_all(F.col("__folded")))
    out = out.withColumn("__decoded", V.decoded_view(F.col("__leet")))
    return out.withColumn("__compact", V.word_chars(F.col("__decoded")))


def with_steps(df: DataFrame, text_col: str, out_col: str = "steps") -> DataFrame:
    """The list of (name, output, note) of each normalization step."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = with_span_views(df, text_col).withColumn("__stripped", V.strip_invisible(raw, V.tables.INVISIBLE_SPANS))
    chain = [
        ("Zero-width stripped", "__stripped", raw, "Removed invisible chars"),
        ("Homoglyph normalized", "__folded", F.col("__stripped"), "Mapped lookalikes"),
        ("De-leeted", "__leet", F.col("__folded"), "Translated leetspeak"),
        ("Base64 recursively decoded", "__decoded", V.collapse_space(F.col("__leet")), "Decoded text"),
    ]
    steps = [F.struct(F.lit("Raw input").alias("name"), raw.alias("output"), F.lit(None).cast("string").alias("note"))]
    for name, col, before, note in chain:
        said = F.when(F.col(col) != before, F.lit(note)).otherwise("no-op")
        steps.append(F.struct(F.lit(name).alias("name"), F.col(col).alias("output"), said.alias("note")))
    steps.append(
        F.struct(
            F.lit("Delimiters compressed").alias("name"),
            F.col("__compact").alias("output"),
            F.lit("Stripped all non-alphanumeric chars").alias("note"),
        )
    )
    return out.withColumn(out_col, F.array(*steps)).drop("__stripped", *[f"__{v}" for v in VIEWS])


def with_hits(df: DataFrame, text_col: str, every: bool = False) -> DataFrame:
    """Add ``hits``: distinct (type, value) with the first place in the raw text.

    A hit of a derived view is traced back to the raw text; inside a decoded token the whole token is its place.  A value
    that only a reduced text holds (``reduced``) stands from its first to its last character.  With ``every``, all direct
    matches of all views are kept, so a value has a hit per place.
    """
    out = with_span_views(df, text_col)
    # A view equal to the one before has the same hits; null skips it.
    sources = {
        "__v0": F.col("__folded"),
        "__v1": F.nullif(F.col("__leet"), F.col("__folded")),
        "__v2": F.nullif(F.col("__decoded"), F.col("__leet")),
        "__v3": F.col("__compact"),
    }
    out = out.withColumns(sources)
    out = out.withColumns({f"{v}_digit": F.coalesce(F.col(v).rlike("[0-9]"), F.lit(False)) for v in sources})
    out = out.withColumns({f"{v}_digits": F.when(F.col(f"{v}_digit"), F.regexp_replace(v, r"\D+", "")) for v in sources})
    for n, column in enumerate(sources):
        base = 100 * n
        direct = [_pattern_hits(t, p, base + i, column) for i, (t, p) in enumerate(COMPILED)]
        out = out.withColumn(f"__h{n}", F.expr(f"concat({', '.join(direct)})"))
        out = out.withColumn(f"__f{n}", F.expr(_fallback_hits(column, f"__h{n}", base + 50)))
    everything = ", ".join(f"__h{n}, __f{n}" for n in range(len(VIEWS)))
    # Sorting brings equal (type, value) together, earliest first; keep the first of each.
    ordered = f"concat({everything})" if every else f"transform(array(array_sort(concat({everything}))), s -> filter(s, " \
        "(h, i) -> i = 0 or not (get(s, i - 1).type = h.type and get(s, i - 1).value = h.value)))[0]"
    names = "array(" + ", ".join(quote(v) for v in VIEWS) + ")"
    listed = (
        f"transform(array_sort(transform({ordered}, h -> named_struct('ord', h.ord, 'start', h.start, 'hit', h))), "
        f"x -> named_struct('type', x.hit.type, 'value', x.hit.value, 'start', x.hit.start, 'end', x.hit.end, "
        f"'view', get({names}, cast(x.ord div 100 as int)), 'reduced', x.hit.start is null))"
    )
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = out.withColumn("hits", settled(F.transform(F.expr(listed), lambda h: _with_place(raw, h))))
    return out.drop(*[f"__{k}{n}" for k in "hfv" for n in range(4)], *[f"__v{n}_digit{s}" for n in range(4) for s in ("", "s")])


def _with_place(raw: Column, h: Column) -> Column:
    """The hit with its place in the raw text instead of the one in its view."""
    at = positions.bound(_place_in_view(h), lambda at: _place_in_raw(raw, h["view"], at))
    kept = [h[c].alias(c) for c in ("type", "value", "view", "reduced")]
    return positions.bound(at, lambda p: F.struct(*kept[:2], p["start"].alias("start"), p["end"].alias("end"), *kept[2:]))


def _view(name: Column) -> Column:
    out = F.col(f"__{VIEWS[-1]}")
    for v in reversed(VIEWS[:-1]):
        out = F.when(name == v, F.col(f"__{v}")).otherwise(out)
    return out


def _place_in_view(h: Column) -> Column:
    """Where a hit stands in its view.  A reduced value stands from its first to its last character."""
    within = lambda gone: lambda v: positions.bound(
        positions.found_at(F.regexp_replace(v, f"[{gone}]+", ""), h["value"]),
        lambda at: F.when(at.isNotNull(), positions.source_place(positions.dropped(v, gone), at)),
    )
    gapped = lambda pattern: lambda v: positions.found_at(v, F.regexp_extract(v, pattern, 0))
    ways = {
        "AADHAAR": within("^0-9"),
        "PAN": gapped(GAPPED_PAN),
        "PHONE_IN": within("^0-9"),
        "DRIVING_LICENSE": gapped(GAPPED_LICENCE),
        "EMAIL": within(V.WIDE_SPACE[1:-1]),
    }

    def reduced(v: Column) -> Column:
        out = F.lit(None).cast(positions.NOWHERE)
        for type_, way in ways.items():
            out = F.when(h["type"] == type_, way(v)).otherwise(out)
        return out

    return F.when(h["reduced"], positions.bound(_view(h["view"]), reduced)).otherwise(positions.place(h["start"], h["end"]))


def _place_in_raw(raw: Column, view: Column, at: Column) -> Column:
    """A place of a view in the raw text: back through the compact view, the decoding rounds and the folding."""
    nowhere = F.lit(None).cast(positions.NOWHERE)
    back = lambda steps, p: F.when(p.isNotNull(), positions.source_place(steps, p)).otherwise(nowhere)
    in_decoded = F.when(view == "compact", back(positions.dropped(F.col("__decoded"), "^A-Za-z0-9_"), at)).otherwise(at)

    def round_back(text: Column, rounds: int, p: Column) -> Column:
        """A place after ``rounds`` rounds of decoding, in the text before them."""
        if rounds == 0:
            return p
        blanks = V.collapse_space(text)
        later = lambda c: V.decode_tokens(c)
        return positions.bound(
            blanks,
            lambda c: positions.bound(
                round_back_of(later(c), rounds - 1, p), lambda q: positions.bound(back(positions.opened(c), q), lambda r: back(positions.collapsed(text), r))
            ),
        )

    def round_back_of(text: Column, rounds: int, p: Column) -> Column:
        return positions.bound(text, lambda t: round_back(t, rounds, p))

    decoded = view.isin("decoded", "compact")
    unchanged = F.col("__decoded") == F.col("__leet")
    in_leet = positions.bound(
        in_decoded, lambda p: F.when(decoded & ~unchanged, round_back(F.col("__leet"), 3, p)).otherwise(p)
    )
    return positions.bound(in_leet, lambda p: F.when(p.isNotNull(), positions.in_raw(raw, p, "spans")))


def _quoted(value: Column) -> Column:
    return F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _place(text: Column, value: Column, token: str) -> Column:
    """Replace the first occurrence of ``value``: exact, else with separators between its characters."""
    exact = F.concat(F.lit(r"(?is)^(.*?)"), _quoted(value))
    spaced = F.array_join(
        F.transform(F.filter(F.split(value, ""), lambda c: c != ""), _quoted), f"[{V.WIDE_SPACE[1:-1]}.\\-_—–/]*"
    )
    loose = F.concat(F.lit(r"(?is)^(.*?)"), spaced)
    put = F.lit(f"$1{token}")
    return (
        F.when(F.regexp_like(text, exact), F.regexp_replace(text, exact, put))
        .when(F.regexp_like(text, loose), F.regexp_replace(text, loose, put))
        .otherwise(text)
    )


def scan_spans(df: DataFrame, text_col: str = "text", keep_views: bool = False) -> DataFrame:
    """Hits, triggered types, typed redaction and action of the span profile."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = with_hits(df, text_col).withColumn("normalized", F.col("__compact")).withColumn("__r", raw)
    seen = []
    # X3, first pass: direct matches in the raw text, type by type
    out = out.withColumn("__digit", raw.rlike("[0-9]"))
    for i, (type_, pattern) in enumerate(COMPILED):
        gate = F.expr(_GATE[type_].replace("{v}", "__r")) if type_ in _GATE else F.col("__digit")
        out = out.withColumn(f"__t{i}", F.when(gate & F.col("__r").rlike(pattern), F.lit(type_)))
        put = F.regexp_replace("__r", pattern, f"[{type_}]")
        out = out.withColumn("__r", F.when(F.col(f"__t{i}").isNotNull(), put).otherwise(F.col("__r")))
        seen.append(f"__t{i}")
    out = out.withColumn("__raw_types", F.array_compact(F.array(*seen)))
    # second pass: values that only exist in a reduced text
    for type_ in ("AADHAAR", "PAN", "PHONE_IN", "DRIVING_LICENSE", "EMAIL"):
        first = F.expr(f"get(filter(hits, h -> h.type = {quote(type_)}), 0)")
        reduced = ~F.array_contains("__raw_types", type_) & first.isNotNull() & first["reduced"]
        out = out.withColumn("__v", F.when(reduced, first["value"]))
        out = out.withColumn(
            "__r", F.when(F.col("__v").isNotNull(), _place(F.col("__r"), F.col("__v"), f"[{type_}]")).otherwise(F.col("__r"))
        )
    hit_types = F.transform("hits", lambda h: h["type"])
    out = out.withColumn("triggered", F.array_distinct(F.concat("__raw_types", hit_types)))
    marks = F.transform("triggered", lambda t: F.concat(F.lit("["), t, F.lit("]")))
    out = out.withColumn("__missing", F.filter(marks, lambda m: ~F.contains(F.col("__r"), m)))
    out = out.withColumn("action", decide.span_action(F.col("triggered")))
    marked = F.concat(F.col("__r"), F.lit(f" ⟪{MARKER}"), F.array_join("__missing", " "), F.lit("⟫"))
    redacted = F.when(F.size("__missing") > 0, marked).otherwise(F.col("__r"))
    out = out.withColumn("redacted_prompt", F.when(F.col("action") == "allow", F.col(text_col)).otherwise(redacted))
    out = out.drop("__r", "__v", "__digit", "__missing", "__raw_types", *seen)
    return out if keep_views else out.drop(*[f"__{v}" for v in VIEWS])


def span_findings(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The hits as rows (type, value, start, end, view, reduced), without a shuffle."""
    found = with_hits(df.select(*keys, text_col), text_col)
    return found.select(*keys, F.explode("hits").alias("h")).select(*keys, "h.*")


def redact_places(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """X3 by place: every hit, of whatever view, replaced in the raw text by ``[TYPE]``; and the number of places.

    Overlapping hits are one place, which takes the type of the hit that starts first, of those the longest.
    """
    found = with_hits(df.select(*keys, text_col), text_col, every=True)
    placed = F.filter("hits", lambda h: h["start"].isNotNull())
    order = F.transform(placed, lambda h: F.struct(h["start"].alias("start"), F.negate(h["end"]).alias("before"), h["type"].alias("type")))
    row = "struct<start:int,end:int,type:string>"

    def add(acc: Column, h: Column) -> Column:
        last, end = F.try_element_at(acc, F.lit(-1)), F.negate(h["before"])
        fresh = F.struct(h["start"].alias("start"), end.alias("end"), h["type"].alias("type"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), last["type"].alias("type"))
        overlaps = (F.size(acc) > 0) & (h["start"] < last["end"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(fresh)))

    places = settled(F.aggregate(F.array_sort(order), F.expr(f"cast(array() as array<{row}>)"), add))
    out = found.select(*keys, text_col, places.alias("__places"))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    since = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__places", i - 1)["end"])
    part = lambda p, i: F.concat(F.substring(raw, since(i) + 1, p["start"] - since(i)), F.lit("["), p["type"], F.lit("]"))
    rest = F.substring(raw, F.coalesce(F.try_element_at("__places", F.lit(-1))["end"], F.lit(0)) + 1, F.length(raw))
    text = F.concat(F.array_join(F.transform("__places", part), ""), rest)
    return out.select(*keys, F.size("__places").cast("long").alias("places"), text.alias("redacted"))
