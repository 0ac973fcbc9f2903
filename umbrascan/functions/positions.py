"""Where a place in a derived view stands in the text that the view was made from.

A view is made from its source piece by piece.  A step says how long a piece is in the view (``out``) and in the source
(``inp``), and whether its characters correspond one by one (``exact``); of other pieces only the whole place is known.
Steps are built only for rows that have something to place, and walked once per place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables
from . import views as V

NOWHERE = "struct<start:int,end:int>"


def bound(col: Column, step: Callable[[Column], Column]) -> Column:
    """``step(col)`` with ``col`` evaluated once."""
    return F.get(F.transform(F.array(col), step), 0)


def place(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _step(out: Column, inp: Column, exact: Column) -> Column:
    return F.struct(out.cast("int").alias("out"), inp.cast("int").alias("inp"), exact.alias("exact"))


def source_place(steps: Column, at: Column) -> Column:
    """The source's (start, end) of the view's (start, end); null if it lies beyond the view.  One walk over the steps."""
    zero, none = F.lit(0), F.lit(None).cast("int")
    first, last = at["start"], at["end"] - 1

    def walk(acc: Column, s: Column) -> Column:
        after = acc["at"] + s["out"]
        begins = F.when(s["exact"], acc["pos"] + first - acc["at"]).otherwise(acc["pos"])
        ends = F.when(s["exact"], acc["pos"] + last - acc["at"] + 1).otherwise(acc["pos"] + s["inp"])
        return F.struct(
            after.alias("at"),
            (acc["pos"] + s["inp"]).alias("pos"),
            F.when(acc["start"].isNull() & (after > first), begins).otherwise(acc["start"]).alias("start"),
            F.when(acc["end"].isNull() & (after > last), ends).otherwise(acc["end"]).alias("end"),
        )

    begin = F.struct(zero.alias("at"), zero.alias("pos"), none.alias("start"), none.alias("end"))
    return F.aggregate(steps, begin, walk, lambda acc: place(acc["start"], acc["end"]))


def dropped(text: Column, gone: str) -> Column:
    """Steps of a view without the characters of a class, given as the inside of ``[...]``."""
    stays = gone[1:] if gone.startswith("^") else f"^{gone}"
    runs = F.regexp_extract_all(text, F.lit(f"[{gone}]+|[{stays}]+"), F.lit(0))
    kept = lambda p: ~p.rlike(f"^[{gone}]")
    return F.transform(runs, lambda p: _step(F.when(kept(p), F.length(p)).otherwise(0), F.length(p), F.lit(True)))


def collapsed(text: Column) -> Column:
    """Steps of ``views.collapse_space``: a run of white space is one blank."""
    wide = V.WIDE_SPACE[1:-1]
    runs = F.regexp_extract_all(text, F.lit(f"[{wide}]+|[^{wide}]+"), F.lit(0))
    space = lambda p: p.rlike(f"^[{wide}]")
    return F.transform(runs, lambda p: _step(F.when(space(p), 1).otherwise(F.length(p)), F.length(p), ~space(p)))


def opened(text: Column) -> Column:
    """Steps of ``views.decode_tokens``: a decoded base64 token stands for all of its text."""
    after = lambda p, i: F.when(i % 2 == 1, V.decode_token(p))
    one = lambda p, i: bound(after(p, i), lambda d: _step(F.length(F.coalesce(d, p)), F.length(p), d.isNull()))
    return F.transform(V.token_pieces(text), one)


def special_chars(profile: str) -> str:
    """Characters that the base view deletes or writes as several, as the inside of a character class."""
    if profile == "spans":
        table, gone = tables.span_alphabet(), tables.INVISIBLE_SPANS
    else:
        table, gone = {**tables.compatibility_chars(), **tables.lookalikes(profile)}, V.NUL + tables.INVISIBLE
    return tables.ranges(map(ord, [*gone, *[k for k, v in table.items() if len(v) > 1]]))


def folded(raw: Column, profile: str) -> Column:
    """Steps of ``views.base_view``."""
    inside = special_chars(profile)
    runs = F.regexp_extract_all(raw, F.lit(f"[{inside}]|[^{inside}]+"), F.lit(0))
    plain = lambda p: ~p.rlike(f"^[{inside}]")
    out = lambda p: F.when(plain(p), F.length(p)).otherwise(F.length(V.base_view(p, profile)))
    return F.transform(runs, lambda p: _step(out(p), F.length(p), plain(p)))


def in_raw(raw: Column, at: Column, profile: str) -> Column:
    """A place of the base view in the raw text."""
    return F.when(raw.rlike(f"[{special_chars(profile)}]"), source_place(folded(raw, profile), at)).otherwise(at)


def found_at(view: Column, value: Column) -> Column:
    """The first place of ``value`` in ``view``; null if it is not there."""
    start = F.nullif(F.position(value, view), F.lit(0)) - 1
    return bound(start, lambda s: F.when(s.isNotNull(), place(s, s + F.length(value))))


def all_found(view: Column, value: Column) -> Column:
    """All places of ``value`` in ``view`` that do not overlap, from left to right."""
    literal = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.slice(F.split(view, literal, -1), F.lit(1), F.size(F.split(view, literal, -1)) - 1)
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{NOWHERE}>)").alias("places"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece)
        end = start + F.length(value)
        return F.struct(end.alias("at"), F.concat(acc["places"], F.array(place(start, end))).alias("places"))

    return F.when(F.length(value) > 0, F.aggregate(pieces, begin, step, lambda acc: acc["places"])).otherwise(begin["places"])


def merged(places: Column) -> Column:
    """Array of (type, start, end, ...) -> per type the unions of overlapping places: (type, start, end, rules, views).

    ``places`` has the fields type, start, end, rule_id and view; those without a start are left out.
    """
    known = F.filter(places, lambda p: p["start"].isNotNull())
    ordered = F.array_sort(
        F.transform(known, lambda p: F.struct(p["type"].alias("type"), p["start"].alias("start"), p["end"].alias("end"), p["rule_id"].alias("rule_id"), p["view"].alias("view")))
    )
    row = "struct<type:string,start:int,end:int,rules:array<string>,views:array<string>>"

    def add(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.struct(p["type"].alias("type"), p["start"].alias("start"), p["end"].alias("end"), F.array(p["rule_id"]).alias("rules"), F.array(p["view"]).alias("views"))
        wider = F.struct(
            last["type"].alias("type"), last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"),
            F.array_union(last["rules"], F.array(p["rule_id"])).alias("rules"), F.array_union(last["views"], F.array(p["view"])).alias("views"),
        )
        overlaps = (F.size(acc) > 0) & (last["type"] == p["type"]) & (p["start"] < last["end"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(fresh)))

    done = F.aggregate(ordered, F.expr(f"cast(array() as array<{row}>)"), add)
    tidy = lambda m: F.struct(m["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), F.array_sort(m["rules"]).alias("rules"), F.array_sort(m["views"]).alias("views"))
    return F.transform(done, tidy)
