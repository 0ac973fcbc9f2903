"""Findings of every view and of the fallback rules with their places in the raw text, against brute force and SQL."""

import base64
import re

import pytest

from umbrascan.functions import tables
from umbrascan.operators import decide, findings, spans
from umbrascan.plans import oracles, registry

SPANS = [
    ("Aadhaar 2345 6789 1012 here", "folded"),
    ("A.B-C D E 1 2 3 4 F", "folded"),
    ("u s e r @ e x a m p l e . c o m", "folded"),
    ("m|h|1|2|2|0|1|9|1|2|3|4|5|6|7", "folded"),
    ("2#3#4#5#6#7#8#9#1#0#1#2", "folded"),
    ("9#8#7#6#5#4#3#2#1#0", "folded"),
    ("pay bob2@y8l now", "leet"),
    ("see dXNlckBleGFtcGxlLmNvbQ== now", "decoded"),
    ("mail a@b.co, a@b.co and c@d.org", "folded"),
    ("AKIA-ABCD-EFGH-IJKL-MNOP", "compact"),
    ("x\u200b жa  mail  a\u200b@b.co,\n\n  9876543210 end", "folded"),
    ("a  b\n dXNlckBleGFtcGxlLmNvbQ==  then\t2345\n6789  1012", "decoded"),
    ("to  ZUdOaFFHcDVlaTVqYjIwPQ==  twice", "decoded"),
    ("nothing at all", None),
    ("", None),
]


def documents(spark, path, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


BLANKS = " \t\n\x0b\x0c\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def brute_views(raw):
    """{view: (text, [(from, to) in raw per character])}, character by character."""
    alphabet, leet = tables.span_alphabet(), tables.LEET_SPANS
    folded = [(x, (i, i + 1)) for i, c in enumerate(raw) if c not in tables.INVISIBLE_SPANS for x in alphabet.get(c, c)]
    swapped = [(leet.get(c, c), at) for c, at in folded]
    now = swapped
    for _ in range(3):
        blanks = []
        for c, (i, j) in now:
            if c in BLANKS:
                if blanks and blanks[-1][2]:
                    blanks[-1] = (" ", (blanks[-1][1][0], j), True)
                else:
                    blanks.append((" ", (i, j), True))
            else:
                blanks.append((c, (i, j), False))
        text, at, now = "".join(c for c, _, _ in blanks), 0, []
        for token in re.split("( )", text):
            span = [p for _, p, _ in blanks[at : at + len(token)]]
            at += len(token)
            said = None
            if re.fullmatch("[A-Za-z0-9+/=]{12,}", token):
                core = re.sub("={1,2}$", "", token) if len(token) % 4 == 0 else token
                if "=" not in core and len(core) % 4 != 1:
                    said = base64.b64decode(core + "=" * (-len(core) % 4)).decode("latin-1")
                    said = said if len(said) > 2 and re.fullmatch(r"[\x20-\x7e\s\xa0]+", said, re.ASCII) else None
            now += [(c, p) for c, p in zip(token, span)] if said is None else [(c, (span[0][0], span[-1][1])) for c in said]
    if "".join(c for c, _ in now) == "".join(c for c, _ in swapped):
        now = swapped
    compact = [(c, p) for c, p in now if re.match("[A-Za-z0-9_]", c)]
    every = {"folded": folded, "leet": swapped, "decoded": now, "compact": compact}
    return {name: ("".join(c for c, _ in v), [p for _, p in v]) for name, v in every.items()}


def brute_hits(view):
    """(type, value, start, end, reduced) in one view: all direct matches, else the reference's reductions."""
    hits = [(t, m[0], *m.span(), False) for t, p in spans.PATTERNS for m in re.finditer(p, view, re.ASCII)]
    seen = {t for t, *_ in hits}

    def reduced(keep, pattern, change=lambda c: c):
        """First match on the kept characters, and the place from its first to its last character."""
        left = [(change(c), i) for i, c in enumerate(view) if re.match(keep, c, re.ASCII)]
        m = re.search(pattern, "".join(c for c, _ in left))
        return m and (m[0], left[m.start()][1], left[m.end() - 1][1] + 1)

    plain = "[A-Za-z0-9]"
    letters = re.search("[a-zA-ZЀ-ӿͰ-Ͽ]", view)
    found = {
        "AADHAAR": reduced("[0-9]", "^[0-9]{12}$"), "PAN": reduced(plain, "[A-Za-z]{5}[0-9]{4}[A-Za-z]"),
        "PHONE_IN": None if letters else reduced("[0-9]", spans.FALLBACK_PHONE),
        "DRIVING_LICENSE": reduced(plain, "[A-Za-z]{2}[0-9]{13}", lambda c: "0" if c in "Oo" else c),
        "EMAIL": reduced(r"\S", spans.FALLBACK_EMAIL),
    }
    upper = ("PAN", "DRIVING_LICENSE")
    return hits + [(t, f[0].upper() if t in upper else f[0], f[1], f[2], True) for t, f in found.items() if f and t not in seen]


def brute_spans(texts):
    want = {}
    for i, text in enumerate(texts):
        for name, (view, at) in brute_views(text).items():
            for type_, value, start, end, reduced in brute_hits(view):
                want.setdefault((i, type_, value), (at[start][0], at[end - 1][1], name, reduced))
    return {(*k, *v) for k, v in want.items()}


def test_span_findings_of_every_view(spark, tmp_path):
    path = documents(spark, tmp_path, [t for t, _ in SPANS])
    rows = registry.QUERIES["span_findings"](spark, path).collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got) and got == brute_spans([t for t, _ in SPANS])
    for r in spans.with_span_views(spark.read.parquet(f"{path}/documents.parquet"), "text").collect():
        assert {v: r[f"__{v}"] for v in spans.VIEWS} == {v: text for v, (text, _) in brute_views(r.text).items()}
    assert {r.view for r in rows} == set(spans.VIEWS)
    for i, (text, view) in enumerate(SPANS):
        assert view is None or view in {r.view for r in rows if r.doc_id == i}, text
    assert {r.type for r in rows if r.reduced} == {"AADHAAR", "PAN", "PHONE_IN", "DRIVING_LICENSE", "EMAIL"}
    assert all(r.start < r.end for r in rows)


def test_redaction_by_place(spark, tmp_path):
    texts = [t for t, _ in SPANS]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: (r.places, r.redacted) for r in spans.redact_places(df, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        hits, types = [], {}
        for view, at in brute_views(text).values():
            hits += [(at[s][0], -at[e - 1][1], t) for t, _, s, e, _ in brute_hits(view)]
        places = []
        for start, end, type_ in sorted(hits):
            if places and start < places[-1][1]:
                places[-1][1] = max(places[-1][1], -end)
            else:
                places.append([start, -end, type_])
        out, since = "", 0
        for start, end, type_ in places:
            out += text[since:start] + f"[{type_}]"
            since = end
        assert got[i] == (len(places), out + text[since:]), text
    assert got[99] == (0, "")


def test_span_severities_count_every_finding(spark, tmp_path):
    path = documents(spark, tmp_path, [t for t, _ in SPANS])
    want = {}
    for _, type_, *_ in brute_spans([t for t, _ in SPANS]):
        key = (decide.SPAN_SEVERITY[type_], type_ in decide.SPAN_BLOCK_TYPES)
        want[key] = want.get(key, 0) + 1
    assert {(r.level, r.blocks): r.n for r in registry.QUERIES["span_severities"](spark, path).collect()} == want


def sql_rows(name, sf):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        return sorted(db.execute(oracles.build()[name]).fetchall())


def test_spans_of_every_view_are_the_sql(spark, sf):
    got = registry.QUERIES["span_findings"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sql_rows("span_findings", sf)


# text, and what has to be found there: rule, value, start, end, view
VALUES = {
    "phone_findings": [
        ("call +91 98765 43210 now", {("phone_country_code", "+91 98765 43210", 5, 20, "base")}),
        ("call 9876543210 now", {("phone_in", "9876543210", 5, 15, "base"), ("phone_us", "9876543210", 5, 15, "base")}),
        ("call 6876l432lO now", {("phone_in", "6876143210", 5, 15, "ocr")}),
        ("call 2l25551234 now", {("phone_us", "2125551234", 5, 15, "ocr")}),
        ("call (415) 555-0123", {("phone_us", "(415) 555-0123", 5, 19, "base")}),
    ],
    "ipv4_findings": [
        ("at 10.0.0.1 or so", {("ipv4", "10.0.0.1", 3, 11, "base")}), ("at 1O.0.0.l2 or so", {("ipv4", "10.0.0.12", 3, 12, "ocr")}),
        ("a\u200bt 10.0.\u200b0.1 or so", {("ipv4", "10.0.0.1", 4, 13, "base")}),
    ],
    "secret_findings": [("p4ssw0rd=hunterhunter", {("generic_secret", "password=hunterhunter", 0, 21, "leet")})],
    "title_name_findings": [("for J\u200b0hn D0e, please", {("name_title_case", "John Doe", 4, 13, "leet")})],
    "card_luhn_findings": [("card 4lll 1111 1111 11l1 now", {("credit_card", "4111 1111 1111 1111", 5, 24, "ocr")})],
    "email_findings": [("to ann@example.com, ann@example.com", {("email", "ann@example.com", 3, 18, "base")})],
}


@pytest.mark.parametrize("name", VALUES)
def test_values_of_every_view_and_rule(spark, tmp_path, name):
    path = documents(spark, tmp_path, [t for t, _ in VALUES[name]])
    rows = registry.QUERIES[name](spark, path).collect()
    got = {(r.doc_id, r.rule_id, r.value, r.start, r.end, r.view) for r in rows}
    assert len(rows) == len(got)
    # a derived view repeats the values that it leaves as they are
    missing = {(i, *v) for i, (_, want) in enumerate(VALUES[name]) for v in want} - got
    assert not missing
    assert {(i, value) for i, _, value, *_ in got} == {(i, v[1]) for i, (_, want) in enumerate(VALUES[name]) for v in want}


@pytest.mark.parametrize("name", VALUES)
def test_values_of_every_view_are_the_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    assert sorted(map(tuple, got.collect())) == sql_rows(name, sf)


def test_merged_places(spark):
    texts = [
        "mail a@b.co, J0hn D0e and a@b.co", "card 4lll 1111 1111 11l1", "api_key = 'abc' token=sk-abcd efgh ijkl mnop qrst uvwx",
        "call 9876543210 or +91 98765 43210", None, "", "\\E a.b\\Q@c.de \\E",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.type, r.start, r.end): (r.rules, r.views, r.text) for r in findings.merged_findings(df, ["doc_id"]).collect()}
    want = {
        (0, "EMAIL_ADDRESS", 5, 11): (["email"], ["base", "leet"], "a@b.co"),
        (0, "EMAIL_ADDRESS", 26, 32): (["email"], ["base", "leet"], "a@b.co"),
        (0, "PERSON", 13, 21): (["name_title_case"], ["leet"], "J0hn D0e"),
        (1, "CREDIT_CARD", 5, 24): (["credit_card"], ["ocr"], "4lll 1111 1111 11l1"),
        (2, "OPENAI_KEY", 0, 54): (["split_key_packed"], ["packed"], texts[2]),
        (2, "SECRET", 0, 54): (["split_key_packed", "split_secret_packed"], ["packed"], texts[2]),
        (3, "PHONE_NUMBER", 5, 15): (["phone_in", "phone_us"], ["base"], "9876543210"),
        (3, "PHONE_NUMBER", 19, 34): (["phone_country_code"], ["base"], "+91 98765 43210"),
    }
    for key, (rules, seen, text) in want.items():
        assert got[key][0] == rules and got[key][2] == text and set(got[key][1]) <= set(seen) | {"ocr", "leet"}, key
    assert all(r[2] == (texts[k[0]])[k[2] : k[3]] for k, r in got.items())
    ordered = sorted(got)
    assert all(a[:2] != b[:2] or a[3] <= b[2] for a, b in zip(ordered, ordered[1:]))
    only = findings.merged_findings(df, ["doc_id"], types=["PERSON"]).collect()
    assert [(r.doc_id, r.start) for r in only] == [(0, 13)]
