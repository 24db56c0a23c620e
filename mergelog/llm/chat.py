"""Chat formatting: records of unlike layouts become canonical turns, then one marked-up text with a loss mask.

A record is a variant (parsed JSON, or a row turned into one). Its fingerprint is a hash
of its nested field paths, at all depths and over all elements of all arrays; only the
variant's own types count, never what a string looks like. A declarative table maps each
layout's paths to where turns, roles and texts lie; the table is applied by fingerprint,
so a new layout is a new row, not new code. Optional paths of a layout give it several
fingerprints. Elements of a layout's list must each have the layout's paths, too.

The template marks turns as <s>[ROLE]role[/ROLE]text</s>. Inside roles and texts a
backslash is doubled and a backslash is put after the first sign of each control
string, so no control string is left and the way back is one rule: a backslash and a
character stand for the character.

Defined results: a null text or role is empty, a null turn is 0; rows of a conversation
are ordered by turn, then role and text; repeated rows are repeated turns. Every row of a
table by turn is a turn with its role as it is, whatever its text looks like. Records of
unknown layouts, of lists whose elements differ, and of empty lists are returned by
`unknown_layouts`, never guessed at. An empty table gives no conversations. Other
columns of the table don't matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Staging

# The template's control strings.
OPEN, CLOSE, ROLE, ROLE_END = "<s>", "</s>", "[ROLE]", "[/ROLE]"
CONTROLS = (OPEN, CLOSE, ROLE, ROLE_END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
LOSS_ROLES = ("assistant",)

# Other names of the canonical roles, in records that aren't rows by turn.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: one list of them, or one path for each role."""

    name: str
    required: tuple[str, ...]  # paths to leaves; [] stands for an array's elements
    optional: tuple[str, ...] = ()
    turns: str = ""  # path of the list
    role: str = ""  # within an element
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, paths joined by a line feed)
    renames: bool = True  # other names of roles become the canonical ones

    def shapes(self) -> list[str]:
        some = chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [shape_of([*self.required, *more]) for more in some]

    def element(self) -> str:
        """The shape of one element of the list."""
        return shape_of([self.role.removeprefix("$."), self.text.removeprefix("$.")])


def shape_of(paths: list[str]) -> str:
    """Nested field paths in the form that _shape gives."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def form(node: dict) -> str:
        kinds = {k.removesuffix("[]"): (": ARRAY<" + form(v) + ">" if k.endswith("[]") else ": " + form(v)) if v else "" for k, v in node.items()}
        return "OBJECT<" + ", ".join(k + kinds[k] for k in sorted(kinds)) + ">"

    return form(tree)


# Known layouts.
LAYOUTS = (
    Layout("row", ("conv_id", "turn", "role", "text"), role="$.role", text="$.text", renames=False),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), turns="$.messages", role="$.role", text="$.content"),
    Layout("conversations", ("conv_id", "conversations[].from", "conversations[].value"), turns="$.conversations", role="$.from", text="$.value"),
    Layout("thread", ("conv_id", "thread.messages[].author.role", "thread.messages[].content.text"), turns="$.thread.messages", role="$.author.role", text="$.content.text"),
    Layout("instruction", ("conv_id", "instruction", "output"), ("input", "system"), fields=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("context", ("conv_id", "instruction", "response"), ("context",), fields=(("user", ("$.instruction", "$.context")), ("assistant", ("$.response",)))),
    Layout("prompt", ("conv_id", "prompt", "completion"), ("system",), fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("response", ("conv_id", "prompt", "response"), ("system",), fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
)


def _shape(record: Column) -> Column:
    """The record's nested field paths, sorted: its schema, merged over all elements, without the types of leaves."""
    return F.regexp_replace(F.schema_of_variant(record), r": [A-Z_]+(\(\d+,\d+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    """A hash of the record's nested field paths."""
    return F.xxhash64(_shape(record))


def _string(path: str, record: Column) -> Column:
    return F.try_variant_get(record, path, "string")


def _turns(layout: Layout, record: Column) -> Column:
    """The layout's turns as an array of (turn, role, text)."""
    turn = F.coalesce(F.try_variant_get(record, "$.turn", "long"), F.lit(0).cast("long"))
    if layout.turns:
        every = F.try_variant_get(record, layout.turns, "array<variant>")
        return F.transform(every, lambda m, i: F.struct(i.cast("long").alias("turn"), _string(layout.role, m).alias("role"), _string(layout.text, m).alias("text")))
    if layout.fields:
        each = []
        for k, (role, paths) in enumerate(layout.fields):
            text = F.concat_ws("\n", *(F.when(_string(p, record) != "", _string(p, record)) for p in paths))
            each.append(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")))
        return F.filter(F.array(*each), lambda t: (t["role"] != "system") | (t["text"] != ""))
    return F.array(F.struct(turn.alias("turn"), _string(layout.role, record).alias("role"), _string(layout.text, record).alias("text")))


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """(conv_id, turn, role, text) from variants; the mapping is chosen by fingerprint, for each record."""
    marked = records.select(F.col(record_col).alias("_r"), fingerprint(F.col(record_col)).alias("_f"))
    named = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in ROLES.items()))
    chosen = F
    for layout in LAYOUTS:
        turns = _turns(layout, F.col("_r"))
        if layout.renames:
            turns = F.transform(turns, lambda t: t.withField("role", F.coalesce(F.try_element_at(named, F.coalesce(t["role"], F.lit(""))), t["role"])))
        chosen = chosen.when(_is(layout), turns)
    rows = marked.select(F.try_variant_get("_r", "$.conv_id", "long").alias("conv_id"), F.explode(chosen).alias("_t"))
    return rows.select("conv_id", F.col("_t.turn").alias("turn"), F.coalesce("_t.role", F.lit("")).alias("role"), F.coalesce("_t.text", F.lit("")).alias("text"))


def _is(layout: Layout) -> Column:
    """Whether a record (_r, with its fingerprint _f) has the layout, with each element of its list."""
    out = F.col("_f").isin(*(F.xxhash64(F.lit(s)) for s in layout.shapes()))
    if layout.turns:
        every = F.try_variant_get("_r", layout.turns, "array<variant>")
        out = out & F.coalesce(F.forall(every, lambda m: fingerprint(m) == F.xxhash64(F.lit(layout.element()))), F.lit(False))
    return out


def unknown_layouts(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The records that no layout maps."""
    marked = records.select("*", F.col(record_col).alias("_r"), fingerprint(F.col(record_col)).alias("_f"))
    known = F.lit(False)
    for layout in LAYOUTS:
        known = known | F.coalesce(_is(layout), F.lit(False))
    return marked.where(~known).drop("_r", "_f")


def rows_as_records(rows: DataFrame) -> DataFrame:
    """Rows by turn as variants: {conv_id, turn, role, text}; nulls are empty, so that all rows have one layout."""
    empty = F.lit("")
    record = F.struct("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.select(F.to_variant_object(record).alias("record"))


def json_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([(json.dumps(r),) for r in records], "j string").select(F.parse_json("j").alias("record"))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one text for each conversation; spans (start, length) in code points of what the loss covers."""
    marked = turns.select("conv_id", F.struct("turn", "role", "text").alias("_t"))
    grouped = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    parts = F.transform("_t", lambda t: F.struct(F.concat(F.lit(OPEN + ROLE), escaped(t["role"]), F.lit(ROLE_END)).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*LOSS_ROLES).alias("loss")))
    split = grouped.select("conv_id", parts.alias("_p"))
    formatted = F.concat_ws("", F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["head"])
        span = F.struct(start.alias("start"), F.length(p["body"]).cast("long").alias("length"))
        return F.struct((start + F.length(p["body"]) + len(CLOSE)).alias("at"), F.when(p["loss"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return split.select("conv_id", formatted.alias("formatted"), F.aggregate("_p", zero, step, lambda s: s["spans"]).alias("loss_spans"))


def parse_chat(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) read back from format_chat's output alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    head = len(OPEN + ROLE)

    def turn(p: Column) -> Column:
        at = F.position(F.lit(ROLE_END), p)
        return F.struct(unescaped(F.substring(p, F.lit(head + 1), at - head - 1)).alias("role"), unescaped(F.substring(p, at + len(ROLE_END), F.length(p))).alias("text"))

    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Formats rows by turn, and more records of any layout; writes the result and reads it back to digests."""
    staging = Staging(rows.sparkSession, "chat")
    records = rows_as_records(rows)
    if more is not None:
        records = records.unionByName(more)
    written = staging.table(format_chat(canonical_turns(records)), "formatted")
    back = parse_chat(written)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
