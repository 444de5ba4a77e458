"""Chat formatting by a finite-state machine over roles, in Spark SQL functions only.

A template declares marks around each role's text, which roles carry loss, and the allowed order of roles. Rows of a
conversation become one string plus the spans of it that carry loss. Control strings inside texts are escaped with a
backslash, and backslashes are doubled, so the string reads back to the very same turns.

One conversation becomes one string, so its text must fit a row; nothing else is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: role to (before, after). Other roles use other_marks, their name between the first two."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    other_marks: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role, next state); a pair that is absent is an error, from which no role leads out
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    accepting: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        """Longest first."""
        found = {m for pair in self.marks.values() for m in pair} | set(self.other_marks)
        return sorted(found, key=lambda m: (-len(m), m))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), template.controls, doubled)


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    plain = reduce(lambda t, c: F.replace(t, F.lit(c[0] + "\\" + c[1:]), F.lit(c)), template.controls, text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _pick(role: Column, cases: dict[str, Column], other: Column) -> Column:
    chosen = reduce(lambda c, kv: c.when(role == kv[0], kv[1]), list(cases.items())[1:], F.when(role == next(iter(cases)), cases[next(iter(cases))]))
    return chosen.otherwise(other)


def final_state(roles: Column, template: Template = DEFAULT) -> Column:
    """The state the machine is in after all roles of the array."""
    table = F.create_map(*[F.lit(x) for state, role, to in template.moves for x in (f"{state}\x00{role}", to)])
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(table[F.concat(s, F.lit("\x00"), r)], F.lit("error")))


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, valid, n_turns, formatted, loss_spans (array of start and length, in characters of `formatted`).

    Takes conv_id, turn, role, text; other columns are ignored. Null text and null role: empty. Turns go by turn (null
    first), ties by role, then text; repeated rows are turns of their own. A row without conv_id is a conversation by itself.
    No rows: no conversations. Texts of any length are formatted whole, as long as their conversation fits a row. A conversation whose roles break the order is formatted all the same, with valid false.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    alone = F.when(turns["conv_id"].isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = turns.select("conv_id", alone, turns["turn"].alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("body", escape(F.col("text"), template))
    before = _pick(F.col("role"), {r: F.lit(m[0]) for r, m in template.marks.items()}, F.concat(F.lit(template.other_marks[0]), escape(F.col("role"), template), F.lit(template.other_marks[1])))
    after = _pick(F.col("role"), {r: F.lit(m[1]) for r, m in template.marks.items()}, F.lit(template.other_marks[2]))
    rows = rows.withColumns({"before": before, "after": after})
    rows = rows.withColumn("size", F.length("before") + F.length("body") + F.length("after"))
    order = Window.partitionBy("conv_id", "alone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"place": F.row_number().over(order), "start": F.sum(F.col("size").cast("long")).over(so_far) - F.col("size")})
    segment = F.struct(
        "place",
        F.concat("before", "body", "after").alias("segment"),
        "role",
        F.col("role").isin(*template.loss_roles).alias("loss"),
        (F.col("start") + F.length("before")).alias("start"),
        F.length("body").cast("long").alias("length"),
    )
    chats = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    return chats.select(
        "conv_id",
        final_state(F.col("segments.role"), template).isin(*template.accepting).alias("valid"),
        F.size("segments").cast("long").alias("n_turns"),
        F.array_join("segments.segment", "").alias("formatted"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def _quoted(marks: list[str]) -> str:
    return "|".join("".join("\\" + c if not c.isalnum() else c for c in m) for m in marks)


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted string again: array of (role, text)."""
    first, middle, last = template.other_marks
    opening = _quoted([b for b, _ in template.marks.values()])
    closing = _quoted([a for _, a in template.marks.values()] + [last])
    turn = f"(?s)({opening}|{_quoted([first])}.*?{_quoted([middle])})(.*?)(?:{closing})"
    opened = F.regexp_extract_all(formatted, F.lit(turn), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(turn), F.lit(2))

    def role(mark: Column) -> Column:
        name = F.substring(mark, F.lit(len(first) + 1), F.length(mark) - len(first) - len(middle))
        known = {b: F.lit(r) for r, (b, _) in template.marks.items()}
        return _pick(mark, known, unescape(name, template))

    return F.zip_with(opened, bodies, lambda o, b: F.struct(role(o).alias("role"), unescape(b, template).alias("text")))


def read_loss(formatted: Column, spans: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), template)), "")
