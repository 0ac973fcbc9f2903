"""Span patterns that don't walk long runs and gaps again from each of their characters."""

import random
import re
import time

from umbrascan.operators import spans

# Python has no \G: a match may begin at the place where the one before it ended
HERE = r"(?:\G|(?<![A-Za-z0-9._%+-]))"


def matches(pattern, text):
    out, at = [], 0
    while True:
        here = re.compile(pattern.replace(r"\G", rf"(?<=\A[\s\S]{{{at}}})"))
        if not (m := here.search(text, at)):
            return out
        out.append(m.span())
        at = m.end()


def test_linear_patterns_match_the_same():
    rnd = random.Random(5)
    kinds = [spans.FALLBACK_EMAIL, dict(spans.PATTERNS)["EMAIL"], spans.GAPPED_PAN, spans.GAPPED_LICENCE, spans.THIRTEEN_GAPPED_DIGITS]
    assert HERE in spans.linear(kinds[0]) and HERE in spans.linear(kinds[1])
    seen = dict.fromkeys(kinds, 0)
    for _ in range(1500):
        texts = ["".join(rnd.choices('ab.c_@@"( )', k=25)), "".join(rnd.choices("abcde--", k=9) + rnd.choices("12340o. ", k=rnd.choice([5, 18])) + ["z"])]
        for pattern in kinds:
            for text in texts:
                plain = [m.span() for m in re.finditer(pattern, text)]
                seen[pattern] += len(plain)
                assert matches(spans.linear(pattern), text) == plain, (pattern, text)
    assert all(seen.values())


def test_gapless_pan_and_licence(spark):
    """Found without gaps as they are with them, the first of several."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("aBcDe -.é", k=12) + rnd.choices("1234 -é", k=6) + rnd.choices("xyZ1-", k=8)) for _ in range(600)]
    texts += ["d-l " + "-".join(rnd.choices("0123456789Oo", k=rnd.choice([12, 13, 14]))) + rnd.choice(["", " ab-12"]) for _ in range(200)]
    texts += ["ab cde-12 34 f, ghijk 5678 l", "ab cd oooooooooooooo", "AB-CD-E1234F" * 2, "", "12345"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, v string")
    df = df.selectExpr("id", "v", "v rlike '[0-9]' v_digit", r"regexp_replace(v, '\\D+', '') v_digits")
    got = {r["id"]: {h["type"]: h["value"] for h in r["h"]} for r in df.selectExpr("id", f"{spans._fallback_hits('v', spans._NONE, 50)} h").collect()}
    found = 0
    for i, t in enumerate(texts):
        for type_, pattern in (("PAN", spans.GAPPED_PAN), ("DRIVING_LICENSE", spans.GAPPED_LICENCE)):
            m = re.search(pattern, t)
            want = m and re.sub("[^A-Za-z0-9]", "", m[0])
            if want and type_ == "DRIVING_LICENSE":
                want = want.replace("O", "0").replace("o", "0")
            assert got[i].get(type_) == (want.upper() if want else None), (t, type_)
            found += want is not None
    assert found > 50


def test_long_runs(spark):
    """A run of 300 000 characters before a mail sign that ends no address: seconds, not the square of its length."""
    texts = ["mail " + "x" * 300_000 + "@ end", "mail " + "x " * 100_000 + "@ end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    start = time.time()
    assert not spans.span_findings(df, ["doc_id"]).filter("type = 'EMAIL'").count()
    assert time.time() - start < 20
