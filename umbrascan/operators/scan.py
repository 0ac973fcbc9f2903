"""The scan job: views, rule evaluation, base64 levels, decision and redaction.

Everything is one row-local projection chain: no shuffle, no Python, no collect.  Base64
content is decoded and scanned inside the row with higher-order functions, so nested
findings need neither an explode nor a regroup of the text table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import views as V
from . import decide, redact
from .rules import (
    EIGHT_DIGITS, ENCODED_RUN_FAST, FOUR_DIGITS, GAPPED_DIGITS, ID_KEYWORD, LEAST_VALUE, MAYBE_FOUR_DIGITS, WHITE_SPACE, Profile,
    profile_of, quote, u,
)

BASE, LEET, OCR, PACKED = "__base", "__leet", "__ocr", "__packed"
LOW_BASE, LOW_LEET, LOW_PACKED = "__low_base", "__low_leet", "__low_packed"  # in small letters, for gates
KEYWORD, DIGIT, REPAIRABLE = "__id_keyword", "__digit", "__repairable"  # row flags
FOUR, EIGHT, GAPPED, SPACE, ASSIGN = "__four", "__eight", "__gapped", "__space", "__assign"
VIEW_COLUMNS = [
    BASE, LEET, OCR, PACKED, LOW_BASE, LOW_LEET, LOW_PACKED, KEYWORD, DIGIT, REPAIRABLE, FOUR, EIGHT, GAPPED, SPACE, ASSIGN,
]
ENCODED_REFS = [
    "base", "leet", "ocr", "packed", "low_base", "low_leet", "low_packed", "id_keyword", "digit", "repairable", "four", "eight",
    "gapped", "space", "assign",
]
MAX_DEPTH = 3
ANY_DIGIT = r"\p{Nd}"


def base_text(text: Column, profile: Profile, nfkc: bool = False) -> Column:
    base = V.base_view(text, profile.name, nfkc)
    return V.dot_to_dash(base) if profile.name == "hardened" else base


def _derived(base: Column, repairable: Column, space: Column) -> dict[str, Column]:
    """Views that are null whenever they would equal the base view; the OCR view also where it can hold no number."""
    leet = F.when(base.rlike("[@431057$]"), V.unless_same(V.leet_fold(base), base))
    ocr = F.when(repairable & base.rlike(V.OCR_RUN), V.unless_same(V.ocr_fold(base), base))
    packed = F.when(F.contains(base, F.lit("=")), F.when(space, V.without_space(base)).otherwise(base))
    return {"leet": leet, "ocr": ocr, "packed": packed}


def _base_only(profile: Profile) -> bool:
    return all(r.views == ("base",) for r in profile.rules)


def _id_keyword(base: Column, leet: Column, low_base: Column, low_leet: Column) -> Column:
    def named(view: Column, low: Column) -> Column:
        gate = F.contains(low, F.lit("aadha")) | F.contains(low, F.lit("uidai"))
        return F.coalesce(gate & view.rlike(ID_KEYWORD), F.lit(False))

    return named(base, low_base) | named(leet, low_leet)


def _numbers(base: Column, repaired: Column, flag: str, known: Column) -> Column:
    """Row flag of digits in a row, looked for only where ``known``, which is necessary for it, holds."""
    test = {"digit": ANY_DIGIT, "gapped": u(GAPPED_DIGITS), "four": u(FOUR_DIGITS), "eight": u(EIGHT_DIGITS)}[flag]
    return repaired | known & base.rlike(test)


def _space(base: Column) -> Column:
    return F.contains(base, F.lit(" ")) | base.rlike(u(WHITE_SPACE))


def _assign(base: Column) -> Column:
    return F.contains(base, F.lit(":")) | F.contains(base, F.lit("=")) & (F.instr(base, "=") + LEAST_VALUE <= F.length(base))


def with_views(df: DataFrame, text_col: str, profile: str | Profile = "standard", nfkc: bool = False) -> DataFrame:
    """Add the view columns the rules of ``profile`` read."""
    profile = profile_of(profile)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.withColumn(BASE, base_text(text, profile, nfkc))
    if _base_only(profile):
        return out.withColumn(DIGIT, F.col(BASE).rlike(ANY_DIGIT))
    base, repaired = F.col(BASE), F.col(OCR).isNotNull()
    out = out.withColumns({REPAIRABLE: base.rlike(MAYBE_FOUR_DIGITS), SPACE: _space(base)})
    derived = _derived(base, F.col(REPAIRABLE), F.col(SPACE))
    out = out.withColumns({LEET: derived["leet"], OCR: derived["ocr"], PACKED: derived["packed"]})
    out = out.withColumns(
        {
            LOW_BASE: F.lower(BASE), LOW_LEET: F.lower(LEET), LOW_PACKED: F.lower(PACKED),
            DIGIT: _numbers(base, repaired, "digit", F.lit(True)), ASSIGN: _assign(base),
        }
    )
    out = out.withColumns(
        {
            KEYWORD: _id_keyword(base, F.col(LEET), F.col(LOW_BASE), F.col(LOW_LEET)),
            GAPPED: _numbers(base, repaired, "gapped", F.col(DIGIT)),
        }
    )
    out = out.withColumn(FOUR, _numbers(base, repaired, "four", F.col(GAPPED)))
    return out.withColumn(EIGHT, _numbers(base, repaired, "eight", F.col(FOUR)))


def view_refs(df: DataFrame) -> dict[str, str]:
    names = {
        "base": BASE, "leet": LEET, "ocr": OCR, "packed": PACKED, "low_base": LOW_BASE, "low_leet": LOW_LEET,
        "low_packed": LOW_PACKED, "id_keyword": KEYWORD, "digit": DIGIT, "repairable": REPAIRABLE, "four": FOUR, "eight": EIGHT,
        "gapped": GAPPED, "space": SPACE, "assign": ASSIGN,
    }
    return {k: c for k, c in names.items() if c in df.columns}


def type_list(profile: Profile, refs: dict[str, str], prefilter: bool = True) -> str:
    """SQL for the types whose rules fire, sorted by name, without duplicates."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for rule in profile.rules:
        groups.setdefault(rule.types, []).append(rule.fires(refs, prefilter))
    cases = []
    for types, hits in groups.items():
        names = ", ".join(quote(t) for t in types)
        cases.append(f"case when {' or '.join(hits)} then array({names}) else cast(array() as array<string>) end")
    return f"sort_array(array_distinct(flatten(array({', '.join(cases)}))))"


# --- base64 levels (P3) -----------------------------------------------------------


def decode_run(run: Column) -> Column:
    """Text of one base64 run; null unless it is padded; undecodable bytes are dropped."""
    padding = F.when(run.endswith("=="), 2).when(run.endswith("="), 1).otherwise(0)
    size = F.octet_length(run) - padding  # a run is ASCII
    core = F.when(padding == 0, run).otherwise(F.substring_index(run, "=", 1))
    padded = (size % 4 == 0) | ((size % 4 == 2) & (padding == 2)) | ((size % 4 == 3) & (padding >= 1))
    text = F.make_valid_utf8(F.try_to_binary(F.when(padded, core), F.lit("base64")).cast("string"))
    return F.replace(text, F.lit("�"), F.lit(""))


def decoded_children(text: Column, profile: Profile, max_runs: int | None, every: bool = False) -> Column:
    """Base views of the texts encoded in ``text``, of at least the profile's least length.

    Unless ``every`` is set, texts are left out in which no rule can fire and which hold no further run: few runs decode to
    anything else.
    """
    runs = F.regexp_extract_all(text, F.lit(ENCODED_RUN_FAST), F.lit(0))
    if max_runs is not None:
        runs = F.slice(runs, 1, max_runs)
    texts = F.filter(F.transform(runs, decode_run), lambda t: F.length(F.left(t, F.lit(profile.min_decoded))) >= profile.min_decoded)
    bases = F.transform(texts, lambda t: base_text(t, profile, False))
    worth = None if every else profile.worth_scanning
    return bases if worth is None else F.filter(bases, lambda t: t.rlike(f"{worth}|{ENCODED_RUN_FAST}"))


def _with_runs(texts: Column) -> Column:
    return F.filter(texts, lambda t: (F.octet_length(t) >= 8) & t.rlike(ENCODED_RUN_FAST))


def encoded_levels(
    df: DataFrame, profile: Profile, max_runs: int | None = None, base: str = BASE
) -> tuple[DataFrame, list[str]]:
    """Add one array column of decoded base views per nesting level."""
    names = [f"__level{i}" for i in range(1, MAX_DEPTH + 1)]
    df = df.withColumn(names[0], decoded_children(F.col(base), profile, max_runs))
    for parent, child in zip(names, names[1:], strict=False):
        df = df.withColumn(
            child,
            F.flatten(F.transform(_with_runs(F.col(parent)), lambda t: decoded_children(t, profile, max_runs))),
        )
    return df, names


def deeper_levels(df: DataFrame, text_col: str = "text", profile: str | Profile = "standard", column: str = "more_levels") -> DataFrame:
    """Add whether base64 content goes on below the ``MAX_DEPTH`` levels that a scan opens, as in the reference."""
    profile = profile_of(profile)
    base = f"{BASE}_depth"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out, levels = encoded_levels(df.withColumn(base, base_text(text, profile)), profile, base=base)
    more = F.exists(levels[-1], lambda t: F.size(decoded_children(t, profile, None, every=True)) > 0)
    return out.withColumn(column, more).drop(base, *levels)


def _encoded_views(profile: Profile, depth: int, texts: Column) -> Column:
    """A struct a text with its views and flags, as ``with_views`` has them; a step reads what the steps before it made."""

    def step(rows: Column, known: list[str], add) -> Column:
        return F.transform(rows, lambda e: F.struct(*[e[k].alias(k) for k in known], *[c.alias(k) for k, c in add(e).items()]))

    if _base_only(profile):
        return F.transform(texts, lambda base: F.struct(F.lit(depth).alias("depth"), base.alias("base")))
    rows = F.transform(texts, lambda base: F.struct(
        F.lit(depth).alias("depth"), base.alias("base"), F.lower(base).alias("low_base"),
        base.rlike(MAYBE_FOUR_DIGITS).alias("repairable"), _space(base).alias("space"), _assign(base).alias("assign"),
    ))
    rows = step(rows, ["depth", "base", "low_base", "repairable", "space", "assign"], lambda e: _derived(e["base"], e["repairable"], e["space"]))
    known = ["depth", "base", "low_base", "repairable", "space", "assign", "leet", "ocr", "packed"]
    rows = step(rows, known, lambda e: {
        "low_leet": F.lower(e["leet"]), "low_packed": F.lower(e["packed"]),
        "digit": _numbers(e["base"], e["ocr"].isNotNull(), "digit", F.lit(True)),
    })
    known += ["low_leet", "low_packed", "digit"]
    rows = step(rows, known, lambda e: {"id_keyword": _id_keyword(e["base"], e["leet"], e["low_base"], e["low_leet"])})
    known += ["id_keyword"]
    for flag, before in (("gapped", "digit"), ("four", "gapped"), ("eight", "four")):
        rows = step(rows, known, lambda e, f=flag, b=before: {f: _numbers(e["base"], e["ocr"].isNotNull(), f, e[b])})
        known += [flag]
    return rows


def _staged(profile: Profile, depth: int, level: str) -> Column:
    return _encoded_views(profile, depth, F.col(level))


def with_encoded_types(
    df: DataFrame, profile: str | Profile, max_runs: int | None = None, prefilter: bool = True,
    column: str = "__encoded",
) -> DataFrame:
    """Types found in base64 content, prefixed once per nesting level."""
    profile = profile_of(profile)
    df, levels = encoded_levels(df, profile, max_runs)
    df = df.withColumn("__staged", F.concat(*[_staged(profile, i + 1, name) for i, name in enumerate(levels)]))
    keys = ["base"] if _base_only(profile) else ENCODED_REFS
    types = type_list(profile, {k: f"e.{k}" for k in keys}, prefilter)
    found = F.expr(f"transform(__staged, e -> transform({types}, t -> concat(repeat('BASE64_', e.depth), t)))")
    return df.withColumn(column, F.array_distinct(F.flatten(found))).drop("__staged", *levels)


# --- jobs --------------------------------------------------------------------------


def settled(col: Column) -> Column:
    """Keep the optimizer from copying a costly column into filters above it.

    Catalyst moves a filter below the projection it reads by inlining the expression,
    which would run every rule twice.  A partition-id test (always true) marks the column
    as not freely copyable; the value is unchanged.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def scan_types(
    df: DataFrame,
    text_col: str = "text",
    profile: str | Profile = "standard",
    *,
    encoded: bool = True,
    max_runs: int | None = None,
    nfkc: bool = False,
    prefilter: bool = True,
    keep_views: bool = False,
) -> DataFrame:
    """Append ``detections``, the sorted list of types found in the text.

    ``max_runs`` limits the base64 runs tried per text (the reference service tries ten);
    by default every run of the whole text is tried.
    """
    profile = profile_of(profile)
    out = with_views(df, text_col, profile, nfkc)
    found = F.expr(type_list(profile, view_refs(out), prefilter))
    if encoded:
        out = with_encoded_types(out, profile, max_runs, prefilter)
        found = F.array_distinct(F.concat(found, F.col("__encoded")))
    out = out.withColumn("detections", settled(F.sort_array(found)))
    out = out.drop("__encoded")
    return out if keep_views else out.drop(*VIEW_COLUMNS)


def scan(
    df: DataFrame,
    text_col: str = "text",
    profile: str | Profile = "standard",
    *,
    coverage: str = "all",
    encoded: bool = True,
    max_runs: int | None = None,
    nfkc: bool = False,
    prefilter: bool = True,
) -> DataFrame:
    """Full decision per row: detections, block, redact, severity and redacted text."""
    profile = profile_of(profile)
    out = scan_types(
        df, text_col, profile,
        encoded=encoded, max_runs=max_runs, nfkc=nfkc, prefilter=prefilter, keep_views=True,
    )
    out = decide.with_decision(out, profile)
    cleaned = redact.redacted(F.col(BASE), profile, coverage)
    out = out.withColumn("redacted_text", F.when(F.col("redact"), cleaned).otherwise(F.col(text_col)))
    return out.drop(*VIEW_COLUMNS)
