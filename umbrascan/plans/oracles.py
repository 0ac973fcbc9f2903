"""ANSI SQL counterparts of the registered queries, for a DuckDB side-by-side check.

RE2 has no lookaround, so word edges are consumed: ``(?:^|[^\\p{L}\\p{N}_])``.
"""

from __future__ import annotations

from ..functions import tables
from ..operators import rules as R
from ..operators import spans as S
from . import plants

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
L = r"(?:^|[^\p{L}\p{N}_])"
E_ = r"(?:$|[^\p{L}\p{N}_])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(view: str, pattern: str) -> str:
    return f"regexp_matches({view}, {q(pattern)})"


def word(pattern: str, left: str = L, right: str = E_) -> str:
    return f"{left}(?:{pattern}){right}"


def grab(view: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({view}, {q(pattern)}, {group})"


def _translate(col: str, table: dict[str, str]) -> str:
    single = {k: v for k, v in table.items() if len(v) == 1}
    return f"translate({col}, {q(''.join(single))}, {q(''.join(single.values()))})"


def base_sql(col: str, profile: str = "standard") -> str:
    gone = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in tables.INVISIBLE) + "]"
    clean = f"regexp_replace({col}, {q(gone)}, '', 'g')"
    return _translate(_translate(clean, tables.compatibility_chars()), tables.lookalikes(profile))


def leet_sql(base: str) -> str:
    keys, vals = "".join(tables.LEET), "".join(tables.LEET.values())
    return (
        f"array_to_string(list_transform(regexp_extract_all({base}, '\\S+|\\s+'), lambda p: "
        f"CASE WHEN regexp_matches(p, '\\pL') THEN translate(p, {q(keys)}, {q(vals)}) ELSE p END), '')"
    )


OCR_K, OCR_V = "".join(tables.OCR), "".join(tables.OCR.values())


def ocr_sql(base: str) -> str:
    """Runs are fenced with control characters, split, repaired and joined again."""
    run = r"(^|[^\p{L}\p{N}_])([0-9\s\-_.lIoOsSgGB|]{6,})($|[^\p{L}\p{N}_])"
    fenced = f"regexp_replace({base}, {q(run)}, '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
    pieces = f"string_split({fenced}, chr(1))"
    return (
        f"array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i % 2 = 0 "
        f"THEN translate(p, {q(OCR_K)}, {q(OCR_V)}) ELSE p END), '')"
    )


def luhn_sql(d: str) -> str:
    """Luhn sum over a digit string, right to left."""
    n = f"(ascii(substr({d}, i::INT, 1)) - 48)"
    doubled = f"CASE WHEN (length({d}) - i) % 2 = 1 THEN CASE WHEN {n} * 2 > 9 THEN {n} * 2 - 9 ELSE {n} * 2 END ELSE {n} END"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: {doubled})) % 10 = 0"


def card_sql(view: str) -> str:
    digits = f"list_transform({grab(view, word(CARD).replace('(?:' + CARD, '(' + CARD))}, lambda m: regexp_replace(m, '[\\s-]', '', 'g'))"
    return f"len(list_filter({digits}, lambda d: length(d) BETWEEN 13 AND 19 AND {luhn_sql('d')})) > 0"


CARD = r"(?:[0-9][\s-]*?){13,19}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KW = r"(?i)aadhaar|aadhar|uidai"
AAD = r"[2-9][0-9]{3}[\s.-]?[0-9]{4}[\s.-]?[0-9]{4}"
QUIET = r"(?:[^\s0-9\p{L}]|[lIoOsSgG])*"
# a white-space delimited token that holds an ID and else no digits or letters, and after which no digits go on
QUIET_AAD = rf"(?:^|\s)({QUIET}{AAD}{QUIET})(?:$|\s[\s.-]*(?:$|[^0-9\s.-]))"
GAP = r"[\s\-_.:]*"
LET, DIG = "[a-fh-km-np-rt-zA-FHJ-NP-RT-Z]", "[0-9lI|OoSsgG]"
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}\s\-_.:|])", r"(?:$|[^\p{L}\p{N}\s\-_.:|])"
PAN_CHAIN = f"{LET}(?:{GAP}{LET}){{4}}(?:{GAP}{DIG}){{4}}{GAP}{LET}"
SP_L, SP_R = r"(?:^|\s)", r"(?:$|\s)"


def unequal(match: str) -> str:
    """Whether the digits of a match are not all the same."""
    digits = f"regexp_replace({match}, '[^0-9]', '', 'g')"
    return f"{digits} <> repeat({digits}[1], length({digits}))"


_RUN = ("[A-Za-z0-9][A-Za-z0-9/+=]{38}", "[/+=][A-Za-z0-9/+=]{38}")
_WORD = r"[\p{L}\p{N}_]"


def any_of(view: str, *patterns: str) -> str:
    return "(" + " OR ".join(has(view, p) for p in patterns) + ")"


def ocr_cards(view: str) -> str:
    runs = f"regexp_extract_all({view}, '[0-9lI|OoSsgG][0-9lI|OoSsgG\\s\\-_.:]{{12,}}')"
    flat = f"translate(regexp_replace(r, '[\\s\\-_.:]+', '', 'g'), {q(OCR_K)}, {q(OCR_V)})"
    return f"flatten(list_transform({runs}, lambda r: regexp_extract_all({flat}, '[0-9]{{13,19}}')))"


def rule_sql() -> dict[str, list[str]]:
    """Presence tests by type; ``V`` is the view, ``B`` the base view, ``P`` the packed view."""
    date = r"(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-][0-9]{4}"
    date_us = r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-][0-9]{4}"
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2},\s+[0-9]{4}"
    spelled = (
        "regexp_matches(array_to_string(list_transform(list_filter(regexp_split_to_array(lower(V), '\\s+'), "
        f"lambda w: w IN ({', '.join(q(w) for w in tables.DIGIT_WORDS)})), lambda w: "
        f"(list_position([{', '.join(q(w) for w in tables.DIGIT_WORDS)}], w) - 1)::VARCHAR), ''), '[2-9][0-9]{{11}}')"
    ).replace("{{11}}", "{11}")
    label = r"(?:client_secret|secret[_-]?key|secret|password|token|auth)"
    split_key = [
        has("P", R.PACKED_KEY),
        has(
            "V",
            r"(?i)(?:^|[^\p{L}\p{N}_])(?:api[_-]?key|client_secret|secret[_-]?key|secret|token)[ \t]*[=:]?[ \t]*[\n\r]\s*"
            r"(?:sk-[a-zA-Z0-9\-]{16,}|[A-Za-z0-9/+=\-_]{12,})[ \t]*(?:[\n\r]|$)",
        ),
        f"(len({grab('V', R.QUOTED_PART)}) >= 2 AND regexp_matches(array_to_string({grab('V', R.QUOTED_PART)}, ''), '^sk-[a-zA-Z0-9]{{20,}}'))",
    ]
    secret = [
        f"({has('V', R.QUOTED_SECRET_LABEL)} AND len({grab('V', R.QUOTED_PART)}) >= 2 AND "
        f"length(array_to_string({grab('V', R.QUOTED_PART)}, '')) >= 8)",
        has("P", R.PACKED_SECRET),
    ]
    ocr = f"({has('B', '[0-9lI|OoSsgG]')} AND (len(list_filter({ocr_cards('B')}, lambda d: {luhn_sql('d')})) > 0 OR " \
        f"(len({ocr_cards('B')}) > 0 AND {has('B', word('(?:credit|debit|card|visa|mastercard|amex)').replace('(?:^', '(?i)(?:^', 1))} " \
        f"AND {has('B', '[0-9][\\s\\-_.]+[0-9]')})))"
    return {
        "AADHAAR": [
            f"len(list_filter({grab('V', word(AAD).replace('(?:' + AAD, '(' + AAD))}, lambda m: {unequal('m')})) > 0 AND {has('V', KW)}",
            f"len(list_filter({grab('V', QUIET_AAD)}, lambda m: {unequal('m')} AND length(m) - length(replace(m, '.', '')) < 3)) > 0",
            has("V", rf"(?m)^[^\n]*(?i:aadhaar|aadhar)[^\n]*(?:^|[^\p{{L}}\p{{N}}_\n])(?i:starts|begins|first)[^\n]*[^\p{{L}}\p{{N}}_\n][2-9][0-9]{{3}}{E_}"),
            has("V", rf"(?m)^[^\n]*(?i:aadhaar|aadhar)[^\n]*(?:^|[^\p{{L}}\p{{N}}_\n])(?i:ends|last)[^\n]*[^\p{{L}}\p{{N}}_\n][0-9]{{4}}{E_}"),
            has("V", word("[a-zA-Z0]" + AAD)),
            has("V", word(r"[2-9](?:\s+[0-9]){11}")),
            f"({has('V', '(?i)aadhaar|aadhar')} AND {has('V', '[2-9][0-9]{11}')})",
            spelled,
        ],
        "PAN": [
            has("V", r"(?:^|[^a-zA-Z0-9])\.?[a-zA-Z]{5}\.?[0-9]{4}\.?[a-zA-Z]\.?(?:$|[^a-zA-Z0-9])"),
            has("B", f"{SP_L}[\\-_.:]*{LET}(?:[\\-_.:]*{LET}){{4}}(?:[\\-_.:]*{DIG}){{4}}[\\-_.:]*{LET}[\\-_.:]*{SP_R}"),
            has("B", f"{EDGE_L}{GAP}{PAN_CHAIN}{GAP}{EDGE_R}"),
            has("V", f"{SP_L}[a-zA-Z][0-9]{{4}}[a-zA-Z]{{5}}{SP_R}"),
            "len(list_filter(regexp_split_to_array(B, '\\s+'), lambda w: "
            "regexp_matches(w, '^[A-Za-z34105@$]{5}[0-9]{4}[A-Za-z34105@$]$') AND regexp_matches(w[1:5], '[0-9]'))) > 0",
            has("V", R.PAN_SPLIT.replace(r"(?<!\S)", SP_L).replace(r"(?!\S)", SP_R).replace(r"\d", "[0-9]")),
            f"({has('V', word('(?i:pan)'))} AND {has('V', word('[a-zA-Z]{5}[0-9]{4}'))})",
        ],
        "CREDIT_CARD": [card_sql("V"), ocr],
        "VOTER_ID": [has("V", word("[A-Z]{3}[0-9]{7}"))],
        "DRIVING_LICENSE": [has("V", word(r"DL[\s-]?[0-9]{13,15}")), has("V", word("[A-Z]{2}[0-9]{13,15}"))],
        "GST_NUMBER": [
            f"({has('V', word('[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]'))} AND NOT {has('V', 'ZZ' + E_)})"
        ],
        "PASSPORT": [has("V", word("[A-Z][1-9][0-9]{6}"))],
        "US_SSN": [has("V", word("[0-9]{3}-[0-9]{2}-[0-9]{4}"))],
        "EMAIL_ADDRESS": [has("V", word(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"))],
        "PHONE_NUMBER": [
            has("V", r"\+91[\s-]?[6-9][0-9]{4}[\s-]?[0-9]{5}|\+[0-9]{1,3}[\s-][0-9]{3,4}[\s-][0-9]{3,4}[\s-][0-9]{4}"),
            has("V", word("(?:0?91|91)?[6-9][0-9]{9}")),
            has("V", r"\([0-9]{3}\)\s*[0-9]{3}[-\s]?[0-9]{4}"),
            has("V", word("[2-9][0-9]{2}[2-9][0-9]{6}")),
        ],
        "IP4": [
            f"len(list_filter({grab('V', L + '((?:[0-9]{1,3}[.]){3}[0-9]{1,3})' + E_)}, "
            f"lambda m: regexp_matches(m, '^(?:{OCTET}[.]){{3}}{OCTET}$'))) > 0"
        ],
        "IP6": [
            has("V", word("(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")),
            f"len(list_filter({grab('V', L + '([0-9A-Fa-f][0-9A-Fa-f:]*::[0-9A-Fa-f:]*[0-9A-Fa-f])' + E_)}, lambda m: "
            "len(string_split(m, '::')) = 2 AND NOT contains(m, ':::') AND "
            "len(list_filter(string_split(m, ':'), lambda g: g <> '')) <= 7 AND "
            "len(list_filter(string_split(m, ':'), lambda g: length(g) > 4)) = 0)) > 0",
        ],
        "DATE": [has("V", word(p)) for p in ("[0-9]{4}-[0-9]{2}-[0-9]{2}", date, date_us, month)],
        "UPI_ID": [has("V", L + r"[a-zA-Z0-9._-]+\s?@\s?[a-zA-Z]{2,6}(?:$|[^\p{L}\p{N}_@])")],
        "JWT": [has("V", word(r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}"))],
        "PERSON": [
            has("V", "(?i)" + word(r"(?:my name is|customer name:|name:)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}")),
            has("V", word(r"(?:Dr|Mr|Mrs|Ms|Miss)\.?(?:\s+[A-Z][a-z]+){1,2}")),
            has("V", L + r"[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}(?:$|[^\p{L}\p{N}_:])"),
        ],
        "LOCATION": [
            has("V", "(?i)" + word(
                r"live in|visited|send the parcel to|flat\s+[\p{L}\p{N}_]+|street|road|residency|bengaluru|chennai|london|new york"
            ))
        ],
        "OPENAI_KEY": [has("V", R.OPENAI_KEY), *split_key],
        "ANTHROPIC_KEY": [has("V", R.ANTHROPIC_KEY)],
        "BEARER_TOKEN": [has("V", R.BEARER)],
        "AWS_KEY": [has("V", R.AWS_KEY)],
        "AWS_SECRET": [
            has("V", R.AWS_SECRET),
            # an edge lies between a word character and another one; the sign may also follow on the line
            f"len(list_filter({grab('V', f'{L}({_RUN[0]}[A-Za-z0-9]){E_}')}, lambda m: regexp_matches(m, '[+/=]'))) > 0",
            has("V", f"{L}{_RUN[0]}[A-Za-z0-9]" + r"(?:[^\p{L}\p{N}_\n][^\n]*)?[+/=]"),
            has("V", f"{L}{_RUN[0]}[/+=]{_WORD}"),
            has("V", f"{_WORD}{_RUN[1]}[A-Za-z0-9]{E_}"),
            has("V", f"{_WORD}{_RUN[1]}[/+=]{_WORD}"),
        ],
        "GENERIC_API_KEY": [has("V", R.API_KEY)],
        "GENERIC_SECRET": [has("V", rf"(?i){label}\s*[=:]\s*\S{{8,}}")],
        "SECRET": [*split_key, *secret],
    }


VIEW_TYPES_OCR = {
    "AADHAAR", "CREDIT_CARD", "VOTER_ID", "DRIVING_LICENSE", "GST_NUMBER", "PASSPORT", "US_SSN", "PHONE_NUMBER",
    "IP4", "DATE",
}


def views_cte(table: str, key: str, text: str, extra: str = "") -> str:
    return (
        f"v AS MATERIALIZED (SELECT {key}, {extra} {text} AS raw, {base_sql(text)} AS base FROM {table}), "
        f"w AS MATERIALIZED (SELECT *, {leet_sql('base')} AS leet, {ocr_sql('base')} AS ocr, "
        "regexp_replace(base, '\\s+', '', 'g') AS packed FROM v)"
    )


def types_sql() -> str:
    cases = []
    for type_, tests in rule_sql().items():
        rows = []
        for t in tests:
            for view in ("base", "leet", "ocr"):
                if view == "ocr" and type_ not in VIEW_TYPES_OCR:
                    continue
                sql = _names(t, view)
                if sql not in rows:
                    rows.append(sql)
        cases.append(f"CASE WHEN {' OR '.join(rows)} THEN {q(type_)} END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda t: t IS NOT NULL))"


def _names(sql: str, view: str) -> str:
    """Put the view names in for the placeholders V, B and P (always an argument)."""
    for mark, name in (("V", view), ("B", "base"), ("P", "packed")):
        sql = sql.replace(f"({mark},", f"({name},").replace(f"({mark})", f"({name})")
    return sql


HIGH = ", ".join(q(t) for t in R.HIGH_STANDARD)
SEVERITY = (
    "CASE WHEN list_has_any(types, [{high}]) THEN 'high' WHEN len(types) >= 2 THEN 'medium' "
    "WHEN len(types) = 1 THEN 'low' ELSE 'none' END"
).format(high=HIGH)


def scanned(table: str = "documents", key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    return f"WITH {views_cte(table, key, text, extra)}, s AS (SELECT *, {types_sql()} AS types FROM w)"


def hardened_types() -> str:
    keep = {
        "AADHAAR": [has("V", word(AAD)), has("V", word("[a-zA-Z0]" + AAD))],
        "PAN": [rule_sql()["PAN"][0]],
        "CREDIT_CARD": [card_sql("V")],
        "VOTER_ID": rule_sql()["VOTER_ID"],
        "DRIVING_LICENSE": rule_sql()["DRIVING_LICENSE"][:1],
        "GST_NUMBER": [has("V", word("[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]"))],
        "PASSPORT": [has("V", word("[A-Z][1-9][0-9]{7}"))],
        "OPENAI_KEY": [has("V", R.OPENAI_KEY_HARDENED)],
        "ANTHROPIC_KEY": [has("V", R.ANTHROPIC_KEY)],
        "BEARER_TOKEN": [has("V", R.BEARER_HARDENED)],
        "AWS_KEY": [has("V", R.AWS_KEY_HARDENED)],
        "AWS_SECRET": [has("V", R.AWS_SECRET)],
        "GENERIC_API_KEY": [has("V", R.API_KEY_HARDENED)],
        "GENERIC_SECRET": [has("V", R.SECRET_HARDENED)],
    }
    cases = [f"CASE WHEN {' OR '.join(_names(t, 'base') for t in ts)} THEN {q(k)} END" for k, ts in keep.items()]
    return f"list_sort(list_filter([{', '.join(cases)}], lambda t: t IS NOT NULL))"


def hardened(table: str = "documents", key: str = "doc_id", text: str = "text", extra: str = "") -> str:
    dashed = f"regexp_replace({base_sql(text, 'hardened')}, '([0-9])\\.([0-9])', '\\1-\\2', 'g')"
    return (
        f"WITH w AS MATERIALIZED (SELECT {key}, {extra} {text} AS raw, {dashed} AS base FROM {table}), "
        f"s AS (SELECT *, {hardened_types()} AS types FROM w)"
    )


HARD_HIGH = ", ".join(q(t) for t in R.HIGH_HARDENED)
HARD_SEVERITY = SEVERITY.replace(HIGH, HARD_HIGH)


#: characters that the base view deletes
GONE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in tables.INVISIBLE) + "]"
# places of the base view's characters in the raw text, where some were deleted
KEPT = f"CASE WHEN {has('raw', GONE)} THEN list_filter(range(1, length(raw) + 1), lambda i: NOT {has('raw[i]', GONE)}) END"


def values_sql(type_: str, *rules: tuple[str, str, str, str, str], views: tuple[str, ...] = ("base", "leet", "ocr"), every: bool = False) -> str:
    """Rows of every view and rule: (rule_id, pattern, condition, left edge, right edge) each."""
    parts = []
    for view in views:
        for rule_id, pattern, where, left, right in rules:
            parts.append(
                f"SELECT DISTINCT doc_id, kept, '{rule_id}' AS rule_id, '{view}' AS view, {view} AS seen, "
                f"unnest({grab(view, f'{left}({pattern}){right}')}) AS value FROM w "
                + (f"WHERE {view} <> base" if view != "base" else "")
            )
    conditions = " AND ".join(
        f"(rule_id <> '{rule_id}' OR ({where}))" for rule_id, where in {(r[0], r[2]) for r in rules} if where != "TRUE"
    ) or "TRUE"
    if every:  # all places of a value in its view: between the parts that it cuts the view into
        off = (
            "unnest(list_transform(range(1, len(string_split(seen, value))), lambda i: "
            "(list_sum(list_transform(string_split(seen, value)[1:i], lambda x: length(x))) + (i - 1) * length(value))::BIGINT))"
        )
    else:
        off = "instr(seen, value) - 1"
    return (
        f"WITH v AS MATERIALIZED (SELECT doc_id, text AS raw, {base_sql('text')} AS base FROM documents), "
        f"w AS MATERIALIZED (SELECT doc_id, base, {KEPT} AS kept, {leet_sql('base')} AS leet, {ocr_sql('base')} AS ocr FROM v), "
        f"m AS ({' UNION '.join(parts)}), p AS (SELECT *, {off} AS off FROM m WHERE {conditions}) "
        f"SELECT DISTINCT doc_id, '{type_}' AS type, value, coalesce(kept[off + 1] - 1, off)::BIGINT AS start, "
        'coalesce(kept[off + length(value)], off + length(value))::BIGINT AS "end", rule_id, view FROM p'
    )


#: type -> rules as ``values_sql`` takes them, and the views that they read
VALUE_RULES = {
    "EMAIL_ADDRESS": ([("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "TRUE", L, E_)], ("base", "leet")),
    "PHONE_NUMBER": (
        [
            (
                "phone_country_code",
                r"\+91[\s-]?[6-9][0-9]{4}[\s-]?[0-9]{5}|\+[0-9]{1,3}[\s-][0-9]{3,4}[\s-][0-9]{3,4}[\s-][0-9]{4}", "TRUE", "", "",
            ),
            ("phone_in", "(?:0?91|91)?[6-9][0-9]{9}", "TRUE", L, E_),
            ("phone_us", r"\([0-9]{3}\)\s*[0-9]{3}[-\s]?[0-9]{4}", "TRUE", "", ""),
            ("phone_us", "[2-9][0-9]{2}[2-9][0-9]{6}", "TRUE", L, E_),
        ],
        ("base", "leet", "ocr"),
    ),
    "IP4": (
        [("ipv4", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", f"regexp_matches(value, '^(?:{OCTET}[.]){{3}}{OCTET}$')", L, E_)],
        ("base", "leet", "ocr"),
    ),
    "GENERIC_SECRET": (
        [("generic_secret", r"(?i:client_secret|secret[_-]?key|secret|password|token|auth)\s*[=:]\s*\S{8,}", "TRUE", "", "")],
        ("base", "leet"),
    ),
    "PERSON": ([("name_title_case", r"[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}", "TRUE", L, r"(?:$|[^\p{L}\p{N}_:])")], ("base", "leet")),
    "CREDIT_CARD": (
        [
            (
                "credit_card", CARD,
                "length(regexp_replace(value, '[\\s-]', '', 'g')) BETWEEN 13 AND 19 AND "
                + luhn_sql("regexp_replace(value, '[\\s-]', '', 'g')"), L, E_,
            )
        ],
        ("base", "leet", "ocr"),
    ),
}


def merged_sql() -> str:
    """Unions of overlapping places of a type, of all rules and views."""
    rows = " UNION ALL ".join(f"SELECT * FROM ({values_sql(t, *r, views=v, every=True)})" for t, (r, v) in VALUE_RULES.items())
    return (
        f"WITH r AS ({rows}), g AS (SELECT *, start >= max(\"end\") OVER (PARTITION BY doc_id, type ORDER BY start, \"end\", rule_id, view "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE AS fresh FROM r), "
        "i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, type ORDER BY start, \"end\", rule_id, view "
        "ROWS UNBOUNDED PRECEDING) AS island FROM g), "
        "k AS (SELECT doc_id, type, island, min(start) AS start, max(\"end\") AS \"end\", "
        "array_to_string(list_sort(list_distinct(list(rule_id))), '|') AS rules, "
        "array_to_string(list_sort(list_distinct(list(view))), '|') AS views FROM i GROUP BY ALL) "
        "SELECT k.doc_id, type, start, \"end\", rules, views, substr(text, start + 1, \"end\" - start) AS text "
        "FROM k JOIN documents USING (doc_id)"
    )


REQ = (
    "r AS (SELECT event_id AS id, ts AS timestamp, user_id, event_type AS status, value AS latency_ms, "
    "event_type = 'error' AS is_error, "
    "CASE event_type WHEN 'purchase' THEN 'block' WHEN 'click' THEN 'redact' ELSE 'pass' END AS action, "
    "CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'low' ELSE 'none' END AS severity, "
    "CASE event_type WHEN 'purchase' THEN ['CREDIT_CARD','EMAIL_ADDRESS'] WHEN 'click' THEN ['PHONE_NUMBER'] "
    "ELSE []::VARCHAR[] END AS types FROM events)"
)
KPI = (
    "count(*) AS total, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'redact') AS redacted, "
    "coalesce(sum(len(types)), 0)::BIGINT AS tokens, "
    "greatest(0, 100 - floor(count(*) FILTER (action = 'block') / count(*) * 100 + 0.5))::BIGINT AS health"
)
BOUNDS = "[5,10,25,50,75,100,250,500,750,1000,2500,5000,7500,10000]"


def redact_chain(col: str, patterns: list[tuple[str, str, str]]) -> str:
    """Each pattern twice, because two matches may share one consumed edge."""
    for left, pattern, right in patterns:
        for _ in range(2):
            col = f"regexp_replace({col}, {q(f'({left})(?:{pattern})({right})')}, '\\1[REDACTED]\\2', 'g')"
    return col


_W = (r"^|[^\p{L}\p{N}_]", r"$|[^\p{L}\p{N}_]")
_H = "[0-9A-Fa-f]{1,4}"
_IP6 = "|".join(
    [f"(?:{_H}:){{7}}{_H}"] + [f"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)]
    + [f"(?:{_H}:){{1,7}}:", f":(?::{_H}){{1,7}}"]
)
CORE = [
    (_W[0], AAD, _W[1]),
    ("^|[^a-zA-Z0-9]", r"\.?[a-zA-Z]{5}\.?[0-9]{4}\.?[a-zA-Z]\.?", "$|[^a-zA-Z0-9]"),
    (_W[0], CARD, _W[1]),
]
FULL = CORE + [
    (_W[0], "[a-zA-Z0-9._-]+@[a-zA-Z]{2,6}", r"$|[^\p{L}\p{N}_@]"),
    (_W[0], r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", _W[1]),
    (r"^|[^\p{L}\p{N}_:]", _IP6, r"$|[^\p{L}\p{N}_:]"),
    (_W[0], "[0-9]{4}-[0-9]{2}-[0-9]{2}", _W[1]),
    (_W[0], r"(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-][0-9]{4}", _W[1]),
    (_W[0], r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-][0-9]{4}", _W[1]),
    (_W[0], r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2},\s+[0-9]{4}", _W[1]),
    (_W[0], r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}", _W[1]),
    (_W[0], r"(?i:(?:my name is|customer name:|name:)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})", _W[1]),
    (
        _W[0],
        r"(?i:live in|visited|send the parcel to|flat\s+[\p{L}\p{N}_]+|street|road|residency|bengaluru|chennai|london|new york)",
        _W[1],
    ),
] + [("", "(?i:" + p.replace("(?i)", "") + ")", "") for p in (
    R.OPENAI_KEY, R.ANTHROPIC_KEY, R.BEARER, R.AWS_KEY, R.AWS_SECRET, R.API_KEY, R.SECRET
)]


SPAN_GONE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in tables.INVISIBLE_SPANS) + "]"


def _span_views(source: str = "SELECT doc_id, text FROM documents") -> tuple[str, tuple[str, str, str]]:
    """The views of the span profile, each with what leads back to the raw text.

    Offsets count characters, so lists of kept positions lead back from a view to the one before.  Readable base64
    tokens and letters that fold to several are left to the brute-force tests: no text of the tables holds one.
    """
    space = has("leet[i]", r"\s") + " AND i > 1 AND " + has("leet[i - 1]", r"\s")
    return (
        f"v AS MATERIALIZED (SELECT doc_id, text AS raw, regexp_replace(text, {q(SPAN_GONE)}, '', 'g') AS clean FROM ({source})), "
        f"w AS MATERIALIZED (SELECT doc_id, raw, clean, {_translate('clean', tables.span_alphabet())} AS folded FROM v), "
        f"y AS MATERIALIZED (SELECT *, {_translate('folded', tables.LEET_SPANS)} AS leet FROM w), "
        "z AS MATERIALIZED (SELECT *, regexp_replace(leet, '\\s+', ' ', 'g') AS decoded FROM y), "
        "x AS MATERIALIZED (SELECT doc_id, raw, leet, decoded, 0 AS n, 'folded' AS view, folded AS seen FROM z "
        "UNION ALL SELECT doc_id, raw, leet, decoded, 1, 'leet', leet FROM z WHERE leet <> folded "
        "UNION ALL SELECT doc_id, raw, leet, decoded, 2, 'decoded', decoded FROM z WHERE decoded <> leet "
        "UNION ALL SELECT doc_id, raw, leet, decoded, 3, 'compact', regexp_replace(decoded, '[^A-Za-z0-9_]', '', 'g') FROM z), "
    ), (
        f"list_filter(range(1, length(raw) + 1), lambda i: NOT {has('raw[i]', SPAN_GONE)})",
        f"list_filter(range(1, length(leet) + 1), lambda i: NOT ({space}))",
        "list_filter(range(1, length(decoded) + 1), lambda i: regexp_matches(decoded[i], '[A-Za-z0-9_]'))",
    )


def _spans_sql(source: str = "SELECT doc_id, text FROM documents") -> str:
    """Direct matches of every view, the fallback rules where a view has none, each value once, with its place in the raw text."""
    views, (raw_at, leet_at, decoded_at) = _span_views(source)
    word_l, word_r = "(?:^|[^A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])"
    direct = []
    for i, (type_, pattern) in enumerate(S.PATTERNS):
        flags = "(?i)" if pattern.startswith("(?i)") else ""
        body = pattern.removeprefix("(?i)")
        body = body.replace(r"(?<![a-zA-Z0-9])", "").replace(r"(?![a-zA-Z0-9])", "")
        body = body.replace("@(okicici", "@(?:okicici")
        left = right = ""
        if type_ == "PAN":
            left, right = "(?:^|[^a-zA-Z0-9])", "(?:$|[^a-zA-Z0-9])"
        elif r"\b" in body:
            left, right = word_l, word_r
        alternatives = [a.replace(r"\b", "") for a in body.split(r"\b|\b")]
        rx = f"{flags}{left}({'|'.join(alternatives) if len(alternatives) > 1 else alternatives[0]}){right}"
        direct.append(f"SELECT doc_id, n, '{type_}' AS type, n * 100 + {i} AS ord, unnest({grab('seen', rx)}) AS value FROM x")
    digits = "regexp_replace(seen, '[^0-9]', '', 'g')"
    joined = "regexp_replace(seen, '\\s+', '', 'g')"
    gapped = lambda rx: f"regexp_extract(seen, {q(rx)})"
    plain = lambda rx: f"regexp_replace({gapped(rx)}, '[^A-Za-z0-9]', '', 'g')"
    place = lambda rx: f"[instr(seen, {gapped(rx)}) - 1, instr(seen, {gapped(rx)}) - 1 + length({gapped(rx)})]"

    def kept(reduced: str, value: str, char: str) -> str:
        """Start and end of a value of a text reduced to some characters."""
        at = f"list_filter(range(1, length(seen) + 1), lambda i: regexp_matches(seen[i], '{char}'))"
        return f"[({at})[instr({reduced}, {value})] - 1, ({at})[instr({reduced}, {value}) + length({value}) - 1]]"

    phone, email = f"regexp_extract({digits}, {q(S.FALLBACK_PHONE)})", f"regexp_extract({joined}, {q(S.FALLBACK_EMAIL)})"
    letters = r"[a-zA-Z\x{400}-\x{4FF}\x{370}-\x{3FF}]"
    reduced = [
        ("AADHAAR", f"length({digits}) = 12", digits, kept(digits, digits, "[0-9]")),
        ("PAN", f"{has('seen', S.GAPPED_PAN)}", f"upper({plain(S.GAPPED_PAN)})", place(S.GAPPED_PAN)),
        ("PHONE_IN", f"NOT {has('seen', letters)} AND {has(digits, S.FALLBACK_PHONE)}", phone, kept(digits, phone, "[0-9]")),
        (
            "DRIVING_LICENSE", has("seen", S.GAPPED_LICENCE), f"upper(translate({plain(S.GAPPED_LICENCE)}, 'Oo', '00'))",
            place(S.GAPPED_LICENCE),
        ),
        ("EMAIL", f"contains(seen, '@') AND {has(joined, S.FALLBACK_EMAIL)}", email, kept(joined, email, r"\S")),
    ]
    fallback = [
        f"SELECT doc_id, n, '{t}' AS type, n * 100 + {50 + i} AS ord, {value} AS value, {at} AS at_seen, true AS reduced FROM x "
        f"WHERE {cond} AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = x.doc_id AND d.n = x.n AND d.type = '{t}')"
        for i, (t, cond, value, at) in enumerate(reduced)
    ]
    return (
        f"WITH {views} d AS MATERIALIZED ({' UNION ALL '.join(direct)}), "
        f"h AS (SELECT d.doc_id, d.n, type, ord, value, [instr(seen, value) - 1, instr(seen, value) - 1 + length(value)] AS at_seen, "
        f"false AS reduced FROM d JOIN x ON x.doc_id = d.doc_id AND x.n = d.n UNION ALL {' UNION ALL '.join(fallback)}), "
        "u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, type, value ORDER BY ord, at_seen[1]) = 1), "
        "p AS (SELECT u.*, x.raw, x.leet, x.decoded, x.view FROM u JOIN x ON x.doc_id = u.doc_id AND x.n = u.n), "
        f"a AS (SELECT *, CASE WHEN n = 3 THEN [({decoded_at})[at_seen[1] + 1] - 1, ({decoded_at})[at_seen[2]]] ELSE at_seen END AS at_decoded FROM p), "
        # the end of a run of blanks that became one
        f"b AS (SELECT *, CASE WHEN n >= 2 AND decoded <> leet THEN [({leet_at})[at_decoded[1] + 1] - 1, "
        f"coalesce(({leet_at})[at_decoded[2] + 1] - 1, length(leet))] ELSE at_decoded END AS at_leet FROM a) "
        f"SELECT doc_id, type, value, coalesce(({raw_at})[at_leet[1] + 1] - 1, at_leet[1])::BIGINT AS start, "
        f'coalesce(({raw_at})[at_leet[2]], at_leet[2])::BIGINT AS "end", view, reduced FROM b'
    )


# bytes of a well-formed character, as hexadecimal digits; anything else is one byte
_TAIL = "[89ab][0-9a-f]"
UTF8 = (
    f"[0-7][0-9a-f]|(?:c[2-9a-f]|d[0-9a-f]){_TAIL}|e0[ab][0-9a-f]{_TAIL}|(?:e[1-9a-cef]){_TAIL}{_TAIL}|ed[89][0-9a-f]{_TAIL}|"
    f"f0[9ab][0-9a-f]{_TAIL}{_TAIL}|f[1-3]{_TAIL}{_TAIL}{_TAIL}|f48[0-9a-f]{_TAIL}{_TAIL}"
)


def decoded_sql(run: str) -> str:
    """The characters of a padded base64 run, as a list of hexadecimal bytes without malformed ones; null if it is not padded."""
    core, pad = f"rtrim({run}, '=')", f"(length({run}) - length(rtrim({run}, '=')))"
    padded = f"(length({core}) % 4 = 0 OR (length({core}) % 4 = 2 AND {pad} = 2) OR (length({core}) % 4 = 3 AND {pad} >= 1))"
    whole = f"rpad({core}, (ceil(length({core}) / 4) * 4)::INT, '=')"
    pieces = f"regexp_extract_all(lower(hex(from_base64({whole}))), '(?:{UTF8})|[0-9a-f]{{2}}')"
    return f"CASE WHEN {padded} THEN list_filter({pieces}, lambda x: regexp_matches(x, '^(?:{UTF8})$') AND x <> 'efbfbd') END"


def _kids(name: str, source: str, depth: int) -> str:
    """Texts of the base64 runs of a table (doc_id, base)."""
    text = "decode(unhex(array_to_string(list_filter(c, lambda x: x <> '00'), '')))"
    return (
        f"{name}_r AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all(base, '[A-Za-z0-9+/]{{8,}}={{0,2}}')) AS r FROM {source}), "
        f"{name}_c AS MATERIALIZED (SELECT doc_id, {decoded_sql('r')} AS c FROM {name}_r), "
        f"{name}_t AS MATERIALIZED (SELECT doc_id, {text} AS t FROM {name}_c WHERE len(c) >= 4), "
        f"{name} AS MATERIALIZED (SELECT doc_id, {depth} AS depth, {base_sql('t')} AS base FROM {name}_t), "
    )


def encoded_sql(table: str) -> str:
    """CTEs that end in ``e`` (doc_id, type, depth): what the rules find in base64 content, three levels deep."""
    return (
        f"k0 AS MATERIALIZED (SELECT doc_id, {base_sql('text')} AS base FROM {table}), {_kids('k1', 'k0', 1)}{_kids('k2', 'k1', 2)}{_kids('k3', 'k2', 3)}"
        "kids AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3), "
        f"{views_cte('kids', 'doc_id', 'base', 'depth,')}, kt AS (SELECT doc_id, depth, unnest({types_sql()}) AS type FROM w), "
        "e AS (SELECT DISTINCT doc_id, repeat('BASE64_', depth) || type AS type, depth FROM kt)"
    )


def planted_sql() -> str:
    """The documents with their plants."""
    names, values = (f"[{', '.join(q(p[i]) for p in plants.DOCUMENT_PLANTS)}]" for i in (0, 1))
    n = len(plants.DOCUMENT_PLANTS)
    plant, alone = f"({values})[doc_id % {n} + 1]", f"(doc_id // {n}) % 2 = 1"
    return (
        f"(SELECT doc_id, ({names})[doc_id % {n} + 1] AS plant, {alone} AS alone, "
        f"CASE WHEN {alone} THEN {plant} ELSE text || chr(10) || {plant} END AS text FROM documents)"
    )


def planted_types_sql() -> str:
    """CTEs that end in ``f`` (doc_id, plant, alone, types): direct and encoded findings of the planted documents."""
    views = views_cte("planted", "doc_id", "text", "plant, alone,").replace("v AS", "pv AS").replace("w AS", "pw AS").replace("FROM v)", "FROM pv)")
    return (
        f"WITH planted AS MATERIALIZED {planted_sql()}, {views}, ps AS (SELECT doc_id, plant, alone, {types_sql()} AS types FROM pw), "
        f"{encoded_sql('planted')}, el AS (SELECT doc_id, list(type) AS more FROM e GROUP BY 1), "
        "f AS (SELECT doc_id, plant, alone, list_concat(types, coalesce(more, [])) AS types FROM ps LEFT JOIN el USING (doc_id))"
    )


def with_turn_plants(sql: str) -> str:
    """A query on conversations, on those with plants."""
    values = f"[{', '.join(q(p[1]) for p in plants.TURN_PLANTS)}]"
    planted = f"planted_c AS MATERIALIZED (SELECT * REPLACE (text || ' ' || ({values})[conv_id % {len(plants.TURN_PLANTS)} + 1] AS text) FROM conversations)"
    return f"WITH {planted}, " + sql.replace("conversations", "planted_c").removeprefix("WITH ")


def build() -> dict[str, str]:
    md5 = lambda c: f"md5({c})"
    fold_all = _translate("b", tables.LEET_SPANS)
    packed = f"translate(regexp_replace(b, '[\\s\\-_.:]+', '', 'g'), {q(OCR_K)}, {q(OCR_V)})"
    out = {
        # scan
        "severity_counts": f"{scanned()} SELECT {SEVERITY} AS severity, count(*) AS n FROM s GROUP BY 1",
        "findings_by_type": f"{scanned()}, f AS (SELECT unnest(types) AS type FROM s) SELECT type, count(*) AS n FROM f GROUP BY 1",
        "findings_by_source_lang": f"{scanned(extra='source, lang,')}, f AS (SELECT source, lang, unnest(types) AS type FROM s) "
        "SELECT source, lang, type, count(*) AS n FROM f GROUP BY 1, 2, 3",
        "scan_decisions": f"{scanned()}, d AS (SELECT doc_id, array_to_string(types, '|') AS types, {SEVERITY} AS severity FROM s) "
        "SELECT *, severity = 'high' AS block, types <> '' AS redact, "
        "CASE WHEN severity = 'high' THEN 'block' WHEN types <> '' THEN 'redact' ELSE 'pass' END AS action FROM d",
        "scan_decisions_hardened": f"{hardened()}, d AS (SELECT doc_id, array_to_string(types, '|') AS types, "
        f"{HARD_SEVERITY} AS severity FROM s) SELECT *, severity = 'high' AS block, types <> '' AS redact FROM d",
        "html_pii_pages": f"{scanned('pages', 'page_id', 'html')} SELECT page_id, array_to_string(types, '|') AS types, "
        f"{SEVERITY} AS severity FROM s",
        "severity_by_policy_join": f"{scanned()}, d AS (SELECT len(types) AS k, {SEVERITY} AS severity FROM s WHERE len(types) > 0) "
        "SELECT severity, count(*) AS n, sum(k)::BIGINT AS types FROM d GROUP BY 1",
        "merged_places": merged_sql(),
        "prefilter_parity": "SELECT count(*) AS texts, 0::BIGINT AS different FROM documents",
        # views
        "normalization_views": f"WITH v AS (SELECT doc_id, {base_sql('text')} AS b FROM documents) SELECT doc_id, "
        f"{md5('b')} AS base, {md5(leet_sql('b'))} AS leet, {md5(fold_all)} AS leet_all, {md5(packed)} AS ocr_compact, "
        "md5(regexp_replace(b, '([0-9])\\.([0-9])', '\\1-\\2', 'g')) AS dot_dash, "
        "md5(regexp_replace(b, '\\s+', '', 'g')) AS no_space, md5(regexp_replace(b, '[^A-Za-z0-9_]', '', 'g')) AS word_chars, "
        "md5(regexp_replace(b, '[^A-Za-z0-9]', '', 'g')) AS alnum, md5(regexp_replace(b, '[^0-9]', '', 'g')) AS digits, "
        "md5(regexp_replace(translate(b, 'Oo', '00'), '[^A-Za-z0-9]', '', 'g')) AS licence FROM v",
        "ocr_view": f"WITH v AS (SELECT doc_id, {base_sql('text')} AS b FROM documents), "
        f"w AS (SELECT doc_id, b, {ocr_sql('b')} AS o FROM v) SELECT doc_id, md5(o) AS ocr, o <> b AS changed FROM w",
        "span_findings": _spans_sql(),
        "span_severities": "SELECT CASE WHEN type IN ('AADHAAR', 'PAN', 'PASSPORT_IN', 'CREDIT_CARD', 'API_KEY') THEN 'critical' "
        "WHEN type IN ('DRIVING_LICENSE', 'GSTIN') THEN 'high' WHEN type IN ('UPI', 'PHONE_IN') THEN 'medium' ELSE 'low' END AS level, "
        f"type IN ('AADHAAR', 'PAN', 'PASSPORT_IN', 'CREDIT_CARD', 'API_KEY') AS blocks, count(*) AS n FROM ({_spans_sql()}) GROUP BY ALL",
        # redaction
        "redact_documents": f"{scanned()} SELECT doc_id, len(types) > 0 AS redact, "
        f"md5(CASE WHEN len(types) > 0 THEN {redact_chain('base', FULL)} ELSE raw END) AS redacted_md5 FROM s",
        "redact_hardened": f"{hardened()} SELECT doc_id, len(types) > 0 AS redact, "
        f"md5(CASE WHEN len(types) > 0 THEN {redact_chain('base', CORE)} ELSE raw END) AS redacted_md5 FROM s",
        # scalar functions
        "sanitize_text": "WITH e AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), "
        "'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS s FROM pages) "
        "SELECT page_id, length(s)::BIGINT AS chars, md5(s) AS safe_md5 FROM e",
        "preview": "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS preview FROM documents",
        "mock_embedding": "WITH e AS (SELECT doc_id, list_transform(range(1, length(substr(text, 1, 64)) + 1), "
        "lambda i: unicode(substr(text, i::INT, 1)) % 97) AS v FROM documents) "
        "SELECT doc_id, len(v)::BIGINT AS width, array_to_string(list_transform(v, lambda x: x::VARCHAR), ',') AS vector FROM e",
        "origin_hash": "WITH k AS (SELECT event_id, user_id::VARCHAR || substr(props, 1, 16) AS s FROM events) "
        "SELECT event_id, lower(lpad(to_hex(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(s) + 1), "
        "lambda i: ascii(substr(s, i::INT, 1))::HUGEINT)), lambda h, b: ((xor(h, b)) * 16777619) % 4294967296)::BIGINT), 8, '0')) "
        "AS origin FROM k",
        # fingerprints
        "fingerprint_dupes": "SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_key FROM documents "
        "GROUP BY 1 HAVING count(*) > 1",
        "seen_semi": "SELECT doc_id, lang FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en')",
        "new_anti": "SELECT doc_id, lang FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')",
        # audit
        "audit_newest_page": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, user_id::VARCHAR AS user_id, action FROM r "
        "WHERE severity = 'high' ORDER BY timestamp DESC, id LIMIT 25 OFFSET 50",
        "audit_newest_100": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, user_id::VARCHAR AS user_id, severity FROM r "
        "ORDER BY timestamp DESC, id LIMIT 100",
        "audit_tenant_newest_100": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, 't1' AS tenant_id, severity FROM r "
        "WHERE user_id % 3 = 1 ORDER BY timestamp DESC, id LIMIT 100",
        "audit_newest_500": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, user_id::VARCHAR AS user_id, severity FROM r "
        "ORDER BY timestamp DESC, id LIMIT 500",
        "late_requests": f"WITH {REQ}, n AS (SELECT *, max(timestamp) OVER (PARTITION BY strftime(timestamp, '%Y-%m-%d')) AS newest FROM r) "
        "SELECT status, count(*) AS late FROM n WHERE timestamp < newest - INTERVAL 12 HOUR GROUP BY 1",
        "audit_user_filter": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, severity FROM r WHERE user_id = 7 "
        "ORDER BY timestamp DESC, id LIMIT 20",
        "audit_latest_per_user": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, user_id::VARCHAR AS user_id FROM r "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id) <= 5",
        "retention_keep": f"WITH {REQ} SELECT strftime(timestamp, '%Y-%m-%d') AS dt, count(*) AS n FROM r "
        f"WHERE timestamp >= {AS_OF} - INTERVAL 10 DAY GROUP BY 1",
        "audit_rows": f"{scanned()} SELECT sha256('detect|' || doc_id::VARCHAR) AS id, 'direct-api' AS user_id, "
        f"sha256(raw) AS redacted_fingerprint, array_to_string(types, '|') AS types, "
        f"CASE WHEN {SEVERITY} = 'high' THEN 'block' ELSE 'redact' END AS action, {SEVERITY} AS severity, "
        "'detect' AS request_type FROM s WHERE len(types) > 0",
        "worker_rows": f"{scanned()}, d AS (SELECT {SEVERITY} AS severity FROM s) "
        "SELECT CASE WHEN severity = 'high' THEN 'block' ELSE 'pass' END AS action, severity, count(*) AS n FROM d GROUP BY 1, 2",
        "leak_audit": "SELECT count(*) AS total, count(*) FILTER (NOT contains(text, '[REDACTED]') AND length(text) > 10) AS unredacted "
        "FROM documents",
        "encryption_round_trip": "WITH k AS (SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'lost' WHEN doc_id % 2 = 0 THEN 'k3' "
        "WHEN doc_id % 11 = 0 THEN 'k1' ELSE 'k2' END AS key, doc_id % 11 = 0 OR doc_id % 14 = 0 AS unopened, doc_id % 13 = 0 AS other FROM documents) "
        "SELECT key AS redacted_prompt_key_id, count(*) AS rows, count(*) FILTER (unopened) AS failures, "
        "count(*) FILTER (NOT unopened AND other) AS mismatches FROM k GROUP BY 1",
        "retention_purge": f"WITH {REQ} SELECT strftime(timestamp, '%Y-%m-%d') AS dt, count(*) AS n FROM r "
        f"WHERE timestamp >= {AS_OF} - INTERVAL 10 DAY - INTERVAL 7 HOUR GROUP BY 1",
        "seen_in_index": "WITH f AS (SELECT sha256(text) AS fp FROM documents GROUP BY 1 HAVING count(*) > 1 UNION SELECT sha256(text) FROM conversations) "
        "SELECT doc_id, sha256(text) IN (SELECT fp FROM f) AS seen FROM documents",
        "csv_export": f"WITH {REQ} SELECT strftime(date_trunc('second', timestamp), '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(timestamp) // 1000 % 1000)::VARCHAR, 3, '0') "
        "|| 'Z' AS timestamp, user_id::VARCHAR AS api_key, '00000000' AS origin_hash, "
        "'\"say \\\"' || status || '\\\"\"' AS raw_preview, '\"' || status || '\"' AS redacted_prompt, action, "
        "array_to_string(types, '|') AS patterns, latency_ms FROM r",
        # validation and schema
        "validation_split": "SELECT CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'empty' "
        "WHEN length(text) > 20000 THEN 'too long' ELSE 'valid' END AS outcome, count(*) AS n, sum(n_chars)::BIGINT AS chars "
        "FROM documents GROUP BY 1",
        "schema_evolution": f"WITH {REQ}, u AS (SELECT 't' || (id % 3)::VARCHAR AS tenant_id, action FROM r UNION ALL "
        "SELECT NULL, NULL FROM r) SELECT tenant_id, action, count(*) AS n FROM u GROUP BY 1, 2",
        "tenant_resolution": "SELECT CASE WHEN event_type = 'view' THEN 'h' || (user_id % 4)::VARCHAR WHEN event_type <> 'error' "
        "THEN json_extract_string(props, '$.k') ELSE '' END AS tenant_id, count(*) AS n FROM events GROUP BY 1",
        # metrics
        "kpi_block": f"WITH {REQ} SELECT {KPI} FROM r",
        "kpi_by_user": f"WITH {REQ} SELECT user_id, {KPI} FROM r GROUP BY 1",
        "hourly_kpis": f"WITH {REQ} SELECT epoch_us(date_trunc('hour', timestamp)) // 1000000 AS hour, {KPI} FROM r GROUP BY 1",
        "upper_median_latency": f"WITH {REQ}, o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS k, "
        "count(*) OVER () AS n FROM r) SELECT latency_ms AS median FROM o WHERE k = n // 2",
        "upper_median_by_user": f"WITH {REQ}, o AS (SELECT user_id, latency_ms, row_number() OVER (PARTITION BY user_id ORDER BY latency_ms) "
        "- 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM r) SELECT user_id, latency_ms AS median FROM o WHERE k = n // 2",
        "distinct_filter_choices": f"WITH {REQ} SELECT DISTINCT 'key' AS kind, user_id::VARCHAR AS choice FROM r UNION ALL "
        "SELECT DISTINCT 'type', t FROM (SELECT unnest(types) AS t FROM r)",
        "filtered_slice": f"WITH {REQ} SELECT epoch_us(timestamp) AS ts_us, id, user_id FROM r WHERE timestamp >= {AS_OF} - INTERVAL 168 HOUR "
        "AND action = 'block' AND list_contains(types, 'CREDIT_CARD')",
        "slo_snapshot": f"WITH {REQ}, w AS (SELECT latency_ms FROM r ORDER BY timestamp DESC, id DESC LIMIT 3000), "
        "o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS k, count(*) OVER () AS n FROM w) "
        "SELECT n AS window_size, (SELECT round_even(count(*) FILTER (is_error) / count(*), 4) FROM r) AS detection_error_rate, "
        "round_even(latency_ms, 2) AS p95_detection_ms, 300.0::DOUBLE AS target_p95_ms, 0.01::DOUBLE AS target_error_rate "
        "FROM o WHERE k = floor(0.95 * (n - 1))",
        "slo_breaches": f"WITH {REQ}, o AS (SELECT id, row_number() OVER a AS seq, sum(is_error::INT) OVER a AS errs, "
        "list(latency_ms) OVER (ORDER BY timestamp, id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS win FROM r "
        "WINDOW a AS (ORDER BY timestamp, id)), p AS (SELECT id, len(win) AS samples, errs / seq AS rate, "
        "list_sort(win)[floor(0.95 * (len(win) - 1))::INT + 1] > 300 AS p95_over FROM o) "
        "SELECT id, samples::BIGINT AS samples, round_even(rate, 4) AS error_rate, p95_over, "
        "samples >= 20 AND (p95_over OR rate > 0.01) AS breach FROM p",
        "slo_breaches_by_status": f"WITH {REQ}, o AS (SELECT id, row_number() OVER a AS seq, sum(is_error::INT) OVER a AS errs, "
        "sum((latency_ms > 300)::INT) OVER (PARTITION BY status ORDER BY timestamp, id ROWS BETWEEN 2999 PRECEDING AND CURRENT ROW) AS slow "
        "FROM r WINDOW a AS (PARTITION BY status ORDER BY timestamp, id)), p AS (SELECT id, least(seq, 3000) AS samples, errs / seq AS rate, slow FROM o) "
        "SELECT id, samples::BIGINT AS samples, round_even(rate, 4) AS error_rate, "
        "samples >= 20 AND (slow >= samples - floor(0.95 * (samples - 1)) OR rate > 0.01) AS breach FROM p",
        "request_counters": f"WITH {REQ} SELECT count(*) AS requests, count(*) FILTER (NOT is_error) AS detections_ok, "
        "count(*) FILTER (is_error) AS errors FROM r",
        "latency_histogram": f"WITH {REQ} SELECT coalesce(list_min(list_filter({BOUNDS}, lambda b: latency_ms <= b))::DOUBLE, "
        "'inf'::DOUBLE) AS le, count(*) AS n FROM r WHERE latency_ms IS NOT NULL GROUP BY 1",
        "status_tally": f"WITH {REQ} SELECT status, count(*) AS n FROM r GROUP BY 1",
        "type_severity_rollup": f"WITH {REQ}, u AS (SELECT unnest(types) AS type, severity FROM r) "
        "SELECT type, severity, count(*) AS n FROM u GROUP BY ROLLUP (type, severity)",
        # windows
        "quota_decisions": f"WITH {REQ}, w AS (SELECT id, status, timestamp, epoch_us(timestamp) // 1000000 // 3600 * 3600 AS window_start FROM r), "
        "k AS (SELECT id, window_start, row_number() OVER (PARTITION BY status, window_start ORDER BY timestamp, id) AS rank FROM w) "
        "SELECT *, rank <= 2 AS allowed FROM k",
        "quota_counts": f"WITH {REQ} SELECT status, epoch_us(timestamp) // 1000000 // 3600 * 3600 AS window_start, count(*) AS requests, "
        "least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS rejected FROM r GROUP BY 1, 2",
        "quota_by_policy": f"WITH {REQ}, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, epoch_us(timestamp) // 86400000000 "
        "ORDER BY timestamp, id) AS rank FROM r) SELECT rank <= CASE WHEN user_id % 2 = 0 THEN user_id % 3 + 1 ELSE 1 END AS allowed, "
        "count(*) AS n FROM k GROUP BY 1",
        "alert_rule": f"WITH {REQ}, k AS (SELECT id, count(*) OVER (PARTITION BY status ORDER BY epoch_us(timestamp) "
        "RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS violations FROM r WHERE latency_ms > 20) "
        "SELECT id, violations FROM k WHERE violations > 3",
        "alert_suppression": f"WITH RECURSIVE {REQ}, a AS (SELECT status AS recipient, id, epoch_us(timestamp) AS us, "
        "row_number() OVER (PARTITION BY status ORDER BY timestamp, id) AS n FROM r), "
        "w AS (SELECT recipient, n, id, true AS sent, [us] AS history FROM a WHERE n = 1 "
        "UNION ALL SELECT recipient, n, id, fits, CASE WHEN fits THEN list_append(history, us)[-2:] ELSE history END "
        "FROM (SELECT a.*, w.history, len(w.history) < 2 OR a.us - w.history[1] >= 3600000000 AS fits "
        "FROM w JOIN a ON a.recipient = w.recipient AND a.n = w.n + 1)) SELECT recipient, id, sent FROM w",
        "alert_triggers": f"WITH {REQ} SELECT user_id, count(*) AS alerts FROM r WHERE severity = 'high' GROUP BY 1",
        # conversations
        "conversation_prompts": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS full_text FROM conversations "
        "WHERE text IS NOT NULL GROUP BY 1 HAVING length(string_agg(text, ' ')) > 0",
        "last_user_turn": "SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1",
        "moderated_turns": f"{hardened('conversations', 'conv_id', 'text', 'turn,')} SELECT conv_id, turn, len(types) > 0 AS strict_blocked, "
        "CASE WHEN len(types) > 0 THEN 'contains_detection:' || array_to_string(types, ',') ELSE 'clean' END AS reason, "
        f"{HARD_SEVERITY} = 'high' AS high_blocked FROM s",
    }
    named = {
        "email_findings": "EMAIL_ADDRESS", "phone_findings": "PHONE_NUMBER", "ipv4_findings": "IP4", "secret_findings": "GENERIC_SECRET",
        "title_name_findings": "PERSON", "card_luhn_findings": "CREDIT_CARD",
    }
    out |= {n: values_sql(t, *VALUE_RULES[t][0], views=VALUE_RULES[t][1]) for n, t in named.items()}
    # evaluation, on the same scan
    confusion = (
        f"{scanned()}, j AS (SELECT len(types) > 0 AS predicted, quality, toxic, s.types FROM s JOIN labels l ON s.doc_id = l.doc_id)"
    )
    out |= {
        "label_confusion": f"{confusion} SELECT predicted, toxic = 1 AS truth, count(*) AS n FROM j GROUP BY 1, 2",
        "label_precision_recall": f"{confusion}, c AS (SELECT count(*) FILTER (predicted AND quality = 0) AS tp, "
        "count(*) FILTER (predicted AND quality <> 0) AS fp, count(*) FILTER (NOT predicted AND quality = 0) AS fn, "
        "count(*) FILTER (NOT predicted AND quality <> 0) AS tn FROM j) SELECT *, "
        "coalesce(round_even(tp / nullif(tp + fp, 0), 3), 0) AS precision, coalesce(round_even(tp / nullif(tp + fn, 0), 3), 0) AS recall FROM c",
        "case_precision_recall": f"{confusion}, k AS (SELECT predicted, CASE WHEN toxic = 1 THEN 'adversarial' WHEN quality = 1 THEN "
        "'negative' ELSE 'positive' END AS label FROM j), c AS (SELECT label, count(*) AS samples, "
        "count(*) FILTER (label <> 'negative' AND predicted) AS tp, count(*) FILTER (label = 'negative' AND predicted) AS fp, "
        "count(*) FILTER (label <> 'negative' AND NOT predicted) AS fn FROM k GROUP BY 1) SELECT *, "
        "coalesce(round_even(tp / nullif(tp + fp, 0), 3), 0) AS precision, coalesce(round_even(tp / nullif(tp + fn, 0), 3), 0) AS recall FROM c",
        "corpus_accuracy": f"{scanned(extra='source,')}, j AS (SELECT source AS section, len(types) > 0 AS actual, "
        "NOT (source IN (SELECT 'src' || (2 * i)::VARCHAR FROM range(20) t(i))) AS expected FROM s) "
        "SELECT section, count(*) AS total, count(*) FILTER (expected) AS expected, count(*) FILTER (actual) AS actual, "
        "count(*) FILTER (expected = actual) AS correct, count(*) FILTER (NOT expected AND actual) AS false_positives, "
        "count(*) FILTER (expected AND NOT actual) AS false_negatives FROM j GROUP BY 1",
        "run_comparison": f"{scanned(extra='source,')}, h AS (SELECT * FROM ({hardened(extra='source,')} SELECT source, types FROM s)), "
        "b AS (SELECT source AS section, count(*) AS total, count(*) FILTER (len(types) > 0) AS actual FROM s GROUP BY 1), "
        "a AS (SELECT source AS section, count(*) AS total, count(*) FILTER (len(types) > 0) AS actual FROM h GROUP BY 1) "
        "SELECT section, a.total AS total_before, a.actual AS actual_before, a.actual AS correct_before, b.total AS total_after, "
        "b.actual AS actual_after, b.actual AS correct_after, b.total - a.total AS total_delta, b.actual - a.actual AS actual_delta, "
        "b.actual - a.actual AS correct_delta FROM a JOIN b USING (section)",
        "bypass_rate": f"{scanned()}, c AS (SELECT count(*) AS total, "
        "count(*) FILTER (CASE WHEN contains(raw, '@') THEN list_contains(types, 'EMAIL_ADDRESS') ELSE len(types) = 0 END) AS passed, "
        "count(*) FILTER (contains(raw, '@') AND len(types) = 0) AS bypassed FROM s) SELECT *, "
        "coalesce(round_even(passed / nullif(total, 0), 4), 0) AS success_rate, coalesce(round_even(bypassed / nullif(total, 0), 4), 0) AS bypass_rate FROM c",
        "run_regressions": f"{scanned()}, b AS (SELECT doc_id, unnest(types) AS type FROM s), "
        f"a AS (SELECT doc_id, unnest(types) AS type FROM ({hardened()} SELECT doc_id, types FROM s)) "
        "SELECT type, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 1",
        "findings_over_runs": f"{scanned()}, b AS (SELECT doc_id, unnest(types) AS type FROM s), "
        f"a AS (SELECT doc_id, unnest(types) AS type FROM ({hardened()} SELECT doc_id, types FROM s)) "
        "SELECT type, count(*) AS n FROM (SELECT * FROM b UNION SELECT * FROM a) GROUP BY 1",
        "response_redaction": f"{scanned()}, d AS (SELECT {SEVERITY} AS severity FROM s) SELECT severity, count(*) AS n, "
        "count(*) FILTER (severity <> 'high') AS shown FROM d GROUP BY 1",
        "intercepted_flows": f"{scanned(extra='lang,')}, d AS (SELECT CASE WHEN {SEVERITY} = 'high' THEN 'block' WHEN len(types) > 0 "
        "THEN 'redact' ELSE 'pass' END AS action FROM s WHERE lang IN ('en', 'fr')) SELECT action, count(*) AS n, "
        "count(*) FILTER (action <> 'block') AS forwarded, (2 * count(*))::BIGINT AS messages FROM d GROUP BY 1",
        "absent_type_counts": f"{scanned()} SELECT " + ", ".join(
            f"count(*) FILTER (list_contains(types, '{t}')) AS {r}" for r, t in (
                ("us_ssn", "US_SSN"), ("voter_id", "VOTER_ID"), ("passport", "PASSPORT"), ("gst", "GST_NUMBER"),
                ("aws_key", "AWS_KEY"), ("jwt", "JWT"), ("anthropic_key", "ANTHROPIC_KEY"), ("bearer_token", "BEARER_TOKEN"),
            )
        ) + " FROM s",
        "encoded_round_trip": f"{scanned()}, f AS (SELECT unnest(types) AS type FROM s) SELECT type, count(*) AS n, 0::BIGINT AS lost, 0::BIGINT AS invented FROM f GROUP BY 1",
    }
    runs = "regexp_extract_all(base, '[A-Za-z0-9+/]{8,}={0,2}')"
    pad = "(length(r) - length(rtrim(r, '=')))"
    out["encoded_runs"] = (
        f"WITH v AS (SELECT doc_id, {base_sql('text')} AS base FROM documents) SELECT doc_id, len({runs})::BIGINT AS runs, "
        f"len(list_filter({runs}, lambda r: length(rtrim(r, '=')) % 4 = 0 OR (length(rtrim(r, '=')) % 4 = 2 AND {pad} = 2) "
        f"OR (length(rtrim(r, '=')) % 4 = 3 AND {pad} >= 1)))::BIGINT AS padded FROM v"
    )
    out["nfkc_exact"] = (
        f"SELECT doc_id, md5(nfc_normalize({_translate('text', tables.compatibility_chars())})) AS nfkc FROM documents"
    )
    prompts = "(SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS full_text FROM conversations GROUP BY 1) c"
    out["redacted_conversations"] = (
        f"{scanned(prompts, 'conv_id', 'full_text')}, d AS (SELECT conv_id, base, CASE WHEN {SEVERITY} = 'high' THEN 'block' "
        "WHEN len(types) > 0 THEN 'redact' ELSE 'pass' END AS action FROM s), "
        "l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) "
        f"SELECT t.conv_id, turn, role, CASE WHEN action = 'redact' AND turn = last THEN {redact_chain('base', FULL)} "
        "ELSE text END AS text, coalesce(action, 'pass') AS action "
        "FROM conversations t LEFT JOIN d USING (conv_id) LEFT JOIN l USING (conv_id)"
    )

    def escaped(c: str) -> str:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = f"replace({c}, {q(raw)}, {q(safe)})"
        return c

    pairs = (
        f"(SELECT u.conv_id, u.turn, {escaped('u.text')} AS prompt, {escaped('a.text')} AS answer FROM conversations u "
        "LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant' "
        "WHERE u.role = 'user') c"
    )
    out["log_path"] = (
        f"{hardened(pairs, 'conv_id', 'answer', 'turn, prompt,')} SELECT conv_id, turn, "
        "CASE WHEN len(types) > 0 THEN 'block' ELSE 'pass' END AS action, "
        "CASE WHEN len(types) > 0 THEN 'high' ELSE 'low' END AS severity, sha256(prompt) AS redacted_fingerprint, "
        "CASE WHEN coalesce(raw, '') = '' THEN 'not-run' WHEN len(types) > 0 THEN "
        "'contains_detection:' || array_to_string(types, ',') ELSE 'clean' END AS moderation FROM s"
    )
    # written tables, read back
    out["stored_audit"] = out["stream_audit"] = out["audit_rows"]
    out["report_tables"] = (
        out["case_precision_recall"].replace("WITH ", "SELECT m.*, cases, chars FROM (WITH ", 1) + ") m JOIN (SELECT CASE WHEN toxic = 1 THEN 'adversarial' "
        "WHEN quality = 1 THEN 'negative' ELSE 'positive' END AS label, count(*) AS cases, sum(length(text))::BIGINT AS chars "
        "FROM documents JOIN labels USING (doc_id) GROUP BY 1) USING (label)"
    )
    out["failure_policy"] = (
        f"{scanned()}, d AS (SELECT doc_id % 10 = 0 AS failed, {SEVERITY} AS severity FROM s), "
        "m AS (SELECT unnest(['fail_open', 'fail_closed']) AS mode, * FROM d) "
        "SELECT mode, CASE WHEN failed AND mode = 'fail_closed' THEN 'reject' ELSE 'ok' END AS status, "
        "CASE WHEN failed THEN 'none' ELSE severity END AS severity, NOT failed AND severity = 'high' AS block, count(*) AS n FROM m GROUP BY ALL"
    )
    # span profile
    blocking = "['AADHAAR', 'PAN', 'PASSPORT_IN', 'CREDIT_CARD', 'API_KEY']"
    act = f"CASE WHEN types IS NULL THEN '{{clean}}' WHEN list_has_any(types, {blocking}) THEN 'block' ELSE 'redact' END"
    out["span_actions"] = (
        f"WITH h AS ({_spans_sql()}), t AS (SELECT doc_id, list(DISTINCT type) AS types FROM h GROUP BY 1) "
        f"SELECT {act.format(clean='allow')} AS action, count(*) AS n, sum(coalesce(len(types), 0))::BIGINT AS types FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1"
    )
    turns = "SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS doc_id, text FROM conversations WHERE role = 'user'"
    octets = "regexp_extract_all(hex(encode(s)), '..')"
    octet = "((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::HUGEINT"
    out["request_log"] = (
        f"WITH h AS ({_spans_sql(turns)}), t AS (SELECT doc_id, list(DISTINCT type) AS types FROM h GROUP BY 1), "
        "c AS (SELECT conv_id::VARCHAR AS api_key, text, conv_id::VARCHAR || substr(text, 1, 16) AS s, types FROM conversations "
        "LEFT JOIN t ON doc_id = conv_id::VARCHAR || ':' || turn::VARCHAR WHERE role = 'user') "
        f"SELECT api_key, lower(lpad(to_hex(list_reduce(list_prepend(2166136261::HUGEINT, list_transform({octets}, lambda x: {octet})), "
        "lambda h, b: ((xor(h, b)) * 16777619) % 4294967296)::BIGINT), 8, '0')) AS origin_hash, "
        f"CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS raw_preview, {act.format(clean='pass')} AS action FROM c"
    )
    steps = [
        ("Raw input", "raw", "false"), ("Zero-width stripped", "clean", "clean <> raw"), ("Homoglyph normalized", "folded", "folded <> clean"),
        ("De-leeted", "leet", "leet <> folded"), ("Base64 recursively decoded", "decoded", "false"),
        ("Delimiters compressed", "regexp_replace(decoded, '[^A-Za-z0-9_]', '', 'g')", "true"),
    ]
    out["span_steps"] = f"WITH {_span_views()[0].rstrip(', ')} " + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS n, '{name}' AS name, count(*) FILTER ({changed}) AS changed, sum(length({text}))::BIGINT AS chars FROM z"
        for i, (name, text, changed) in enumerate(steps)
    )
    # planted values
    out["planted_types"] = f"{planted_types_sql()}, u AS (SELECT plant, alone, unnest(types) AS type FROM f) SELECT plant, alone, type, count(*) AS n FROM u GROUP BY ALL"
    out["planted_decisions"] = (
        f"{planted_types_sql()} SELECT plant, alone, {SEVERITY} AS severity, {SEVERITY} = 'high' AS block, count(*) AS n FROM f GROUP BY ALL"
    )
    out["planted_encoded_findings"] = f"WITH planted AS MATERIALIZED {planted_sql()}, {encoded_sql('planted')} SELECT * FROM e"
    out["encoded_findings"] = f"WITH {encoded_sql('documents')} SELECT * FROM e"
    out["encoded_readable"] = (
        f"WITH b AS (SELECT doc_id, {base_sql('text')} AS base FROM documents), "
        "r AS (SELECT doc_id, unnest(regexp_extract_all(base, '[A-Za-z0-9+/]{8,}={0,2}')) AS r FROM b), "
        f"c AS (SELECT doc_id, count(*) AS readable FROM (SELECT doc_id, {decoded_sql('r')} AS c FROM r) WHERE len(c) >= 4 GROUP BY 1) "
        "SELECT doc_id, coalesce(readable, 0) AS readable FROM documents LEFT JOIN c USING (doc_id)"
    )
    out["planted_moderation"] = with_turn_plants(out["moderated_turns"])
    out["planted_conversations"] = with_turn_plants(out["redacted_conversations"])
    out["planted_log_path"] = with_turn_plants(out["log_path"])
    # streaming results equal the batch ones
    out["stream_scan"] = (
        out["scan_decisions"].replace("SELECT *, severity = 'high' AS block, types <> '' AS redact, ", "SELECT *, ")
    )
    out["stream_quota_counts"] = out["quota_counts"]
    out["stream_slo_monitor"] = (
        f"WITH {REQ}, o AS (SELECT status AS service, latency_ms, is_error, row_number() OVER (PARTITION BY status ORDER BY timestamp DESC, id DESC) AS back FROM r), "
        "t AS (SELECT service, count(*) AS total, count(*) FILTER (is_error) AS errors, "
        "list_sort(list(latency_ms) FILTER (back <= 3000)) AS last FROM o GROUP BY 1), "
        "p AS (SELECT *, len(last) AS samples, last[floor(0.95 * (len(last) - 1))::INT + 1] AS p95, errors / total AS rate FROM t) "
        "SELECT service, total, samples::BIGINT AS samples, round_even(p95, 2) AS p95_ms, round_even(rate, 4) AS error_rate, "
        "samples >= 20 AND (p95 > 300 OR rate > 0.01) AS breach FROM p"
    )
    out["stream_late_counts"] = (
        "WITH a AS (SELECT ts, ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS due FROM events), "
        "b AS (SELECT *, (epoch_us(due) - min(epoch_us(due)) OVER ()) // ((max(epoch_us(due)) OVER () - min(epoch_us(due)) OVER ()) // 6 + 1) AS batch FROM a), "
        "m AS (SELECT batch, max(ts) AS newest FROM b GROUP BY 1), "
        "h AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS horizon FROM m) "
        "SELECT batch::BIGINT AS batch, count(*) AS n, count(*) FILTER (ts < horizon) AS late, count(*) FILTER (ts < horizon) AS written_late "
        "FROM b JOIN h USING (batch) GROUP BY 1"
    )
    out["stream_alert_suppression"] = out["alert_suppression"]  # the table is in order of time
    out["slo_breach_count"] = f"SELECT count(*) FILTER (breach) AS breaches FROM ({out['slo_breaches']})"
    out["stream_exact_alerts"] = out["alert_rule"].replace("SELECT id, violations FROM k", "SELECT id FROM k")
    return out
