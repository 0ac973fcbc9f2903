"""Chat formatting by schema fingerprints, in native functions only.

A record is a variant.  Its nested field paths, sorted and hashed, are its fingerprint; the fingerprint selects a
declarative layout that says where the turns are.  Turns are rendered as

    ### role: text</turn>

with ``###``, ``</turn>`` and the escape character itself written as escapes inside roles and texts, so that a rendered
conversation can always be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role string, text string>>"
START, MIDDLE, END = "### ", ": ", "</turn>\n"
#: control string -> its escape; the escape character goes first
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c "))


@dataclass(frozen=True)
class Layout:
    """Where one kind of record keeps its turns.

    ``fields``: (role, path) of single texts, in order.  ``rows``: (array path, role field, text field) of a list of
    turns, after the fields.  ``also``: paths that may be there besides and carry no turn.  ``roles``: renamed roles.
    ``join``: paths whose texts are appended to the field before, after a line break, if not empty.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str] | None = None
    join: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = field(default=())

    def shapes(self) -> list[frozenset[str]]:
        """The sets of paths that this layout stands for: all its own, with or without each optional and further one."""
        paths = {p for _, p in self.fields} | set(self.join)
        if self.rows:
            paths |= {f"{self.rows[0]}[].{f}" for f in self.rows[1:]}
        sets = [frozenset(paths - set(self.optional))]
        for extra in (*self.optional, *self.also):
            sets += [s | {extra} for s in sets]
        return sets


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("row", fields=(("$role", "text"),), also=("conv_id", "turn", "role")),
    Layout("messages", rows=("messages", "role", "content"), also=("id", "source"), roles=_NAMES),
    Layout("conversations", rows=("conversations", "from", "value"), fields=(("system", "system"),), optional=("system",), also=("id",), roles=_NAMES),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output")), join=("input",), optional=("input",), also=("id",)),
    Layout("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",), also=("id",)),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion")), also=("id",)),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer")), also=("id", "context")),
    Layout("nested", fields=(("user", "request.prompt"), ("assistant", "reply.text")), also=("id", "meta.model")),
)


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths, key=str.encode)).encode()).hexdigest()


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a variant: ``a``, ``a.b``, ``a[].b``; of containers only their leaves."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"((?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|[A-Z][A-Z_0-9]*(?:\([0-9,]+\))?)"), F.lit(1))
    top = lambda s: F.try_element_at(s, F.lit(-1))
    pop = lambda s, n: F.slice(s, F.lit(1), F.greatest(F.size(s) - n, F.lit(0)))
    path = lambda s: F.array_join(F.filter(s, lambda x: x != "{"), "")
    name = lambda t: F.replace(F.regexp_replace(F.substr(t, F.lit(1), F.length(t) - 2), "^`|`$", ""), F.lit("``"), F.lit("`"))

    def step(acc: Column, t: Column) -> Column:
        stack, paths = acc["stack"], acc["paths"]
        closed = pop(stack, 1)
        after = F.when((F.size(closed) > 0) & F.startswith(top(closed), F.lit(".")), pop(closed, 1)).otherwise(closed)
        leaf = F.when((F.size(stack) > 0) & F.startswith(top(stack), F.lit(".")), pop(stack, 1)).otherwise(stack)
        is_name = F.endswith(t, F.lit(": "))
        return F.struct(
            F.when(is_name, F.concat(stack, F.array(F.concat(F.lit("."), name(t)))))
            .when(t == "OBJECT<", F.concat(stack, F.array(F.lit("{"))))
            .when(t == "ARRAY<", F.concat(stack, F.array(F.lit("[]"))))
            .when(t == ">", after)
            .otherwise(leaf)
            .alias("stack"),
            F.when(is_name | t.isin("OBJECT<", "ARRAY<", ">"), paths).otherwise(F.concat(paths, F.array(path(stack)))).alias("paths"),
        )

    none = F.array().cast("array<string>")
    found = F.aggregate(tokens, F.struct(none.alias("stack"), none.alias("paths")), step, lambda acc: acc["paths"])
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^\.", ""))))


def _text(record: Column, path: str) -> Column:
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.coalesce(F.try_variant_get(record, "$" + steps, "string"), F.lit(""))


def _turns(record: Column, layout: Layout) -> Column:
    """The canonical turns of a record of this layout."""
    renamed = lambda role: F.coalesce(F.create_map(*[F.lit(x) for p in layout.roles for x in p])[role], role) if layout.roles else role
    parts = []
    for i, (role, path) in enumerate(layout.fields):
        text = _text(record, path)
        if i == 0:
            for more in layout.join:
                text = F.when(_text(record, more) == "", text).otherwise(F.concat(text, F.lit("\n"), _text(record, more)))
        who = _text(record, role[1:]) if role.startswith("$") else F.lit(role)
        turn = F.array(F.struct(who.alias("role"), text.alias("text")))
        empty = F.array().cast(TURNS)
        parts.append(F.when(_text(record, path) != "", turn).otherwise(empty) if path in layout.optional else turn)
    if layout.rows:
        array, role, text = layout.rows
        held = F.try_variant_get(record, f"$['{array}']", f"array<struct<`{role}` string, `{text}` string>>")
        one = lambda t: F.struct(renamed(F.coalesce(t[role], F.lit(""))).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))
        parts.append(F.coalesce(F.transform(held, one), F.array().cast(TURNS)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to rows with a variant; columns of these names are replaced.

    A null record, one that is no object and one of an unknown fingerprint have a null layout and no turns.
    """
    out = records.withColumn("fingerprint", F.sha2(F.array_join(field_paths(F.col(record)), "\n"), 256))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in layouts:
        hit = F.col("fingerprint").isin(*sorted({fingerprint(s) for s in layout.shapes()}))
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(F.col(record), layout)).otherwise(turns)
    return out.withColumn("layout", name).withColumn("turns", turns)


def escape(text: Column) -> Column:
    for plain, written in ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """Reads escapes from left to right: each starts with the escape character, which is never left alone."""
    for plain, written in reversed(ESCAPES[1:]):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.replace(text, F.lit(ESCAPES[0][1]), F.lit(ESCAPES[0][0]))


def render(turns: Column) -> Column:
    """Turns (role, text) -> struct of the formatted text and the spans (start from 0, length) of the loss mask."""
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escape(F.coalesce(t["role"], F.lit(""))), F.lit(": "), F.lit("\\c ")), F.lit(MIDDLE)).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    sized = F.transform(pieces, lambda p: F.struct(p["loss"].alias("loss"), F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body")))
    none = F.array().cast("array<struct<start bigint, length bigint>>")

    def walk(acc: Column, p: Column) -> Column:
        here = F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))
        return F.struct(
            (acc["at"] + p["head"] + p["body"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(here))).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(sized, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), walk, lambda acc: acc["spans"])
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return F.struct(text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    lines = F.filter(F.split(formatted, r"</turn>\n"), lambda x: x != "")

    def turn(line: Column) -> Column:
        at = F.instr(line, MIDDLE)
        role = F.substr(line, F.lit(len(START) + 1), at - len(START) - 1)
        return F.struct(
            unescape(F.replace(role, F.lit("\\c "), F.lit(": "))).alias("role"),
            unescape(F.substr(line, at + len(MIDDLE))).alias("text"),
        )

    return F.transform(lines, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, joined without a gap."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_turn_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations given as a row per turn: conv_id, turns, formatted, loss_spans.

    Each row is a record of its own, whose layout the fingerprint selects.  Turns are ordered by ``turn`` (null first),
    then role and text, so repeated rows have a defined place.  A null role is an empty one, a null text is empty, rows
    of a null id are a conversation of their own.  A conversation is one value, and so must fit in a task.
    """
    named = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    record = F.to_variant_object(F.struct("conv_id", "turn", "role", "text"))
    turns = canonical(named.select("conv_id", "turn", record.alias("record"))).select("conv_id", "turn", F.get("turns", F.lit(0)).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col("t.role").alias("role"), F.col("t.text").alias("text"))))
    grouped = turns.groupBy("conv_id").agg(ordered.alias("t"))
    shaped = grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return shaped.withColumn("out", render(F.col("turns"))).select("conv_id", "turns", "out.formatted", "out.loss_spans")


def format_records(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Rows with a variant, a conversation each -> their columns, fingerprint, layout, turns, formatted, loss_spans.

    A record of an unknown layout has no turns and an empty formatted text; it isn't dropped.
    """
    done = canonical(records.drop("formatted", "loss_spans"), record, layouts).withColumn("out", render(F.col("turns")))
    return done.select(*[c for c in done.columns if c != "out"], "out.formatted", "out.loss_spans")
