"""Chat formatting with schema fingerprints; DataFrame functions only.

A record's layout is known by the fingerprint of its nested field paths. Each known fingerprint selects a
declarative mapping to canonical turns (role, text). Tables are recognised by their schema, JSON records one by
one by the schema of their own value. Canonical conversations are rendered with turn marks; control strings
inside texts are escaped reversibly, so that the formatted text can be read back without the table.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.llm.common import numbered, position

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """paths: field paths that make the layout, lists as []; turns: for lists, (list, role, text) and what roles are
    called; for flat layouts, (role, field) pairs in order, of which the optional ones are left out if null or empty."""

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


_SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn")),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("shared conversations", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles=_SHARED_ROLES),
    Mapping("turns", ("turns", "turns[].role", "turns[].text"), items=("turns", "role", "text"), roles=_SHARED_ROLES),
    Mapping("prompt and completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system, prompt and response", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("instruction and output", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction, input and output", ("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("question and answer", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
)
#: Names that mean something to a mapping; fields of other names don't enter a fingerprint.
KNOWN_NAMES = frozenset(name for m in MAPPINGS for path in m.paths for name in re.split(r"\[\]\.|\.", path))


def hashed(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema, lists as [], without fields whose name no mapping knows."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        if f.name in KNOWN_NAMES:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *field_paths(f.dataType, path)]
    return out


def fingerprint(kind: T.DataType) -> str:
    return hashed(field_paths(kind))


BY_FINGERPRINT = {hashed(m.paths): m for m in MAPPINGS}


#: Mappings from the one with most paths to the one with fewest: of those that fit, the first counts.
BY_SIZE = sorted(MAPPINGS, key=lambda m: -len(m.paths))


def mapping_of(df: DataFrame) -> Mapping:
    """The mapping of a table's layout: by the fingerprint of all its known paths; if there are more of them than any mapping
    has, by the fingerprint of those that a mapping wants, the one with most paths first. A ValueError names the paths
    of a layout that no mapping knows."""
    paths = field_paths(df.schema)
    found = BY_FINGERPRINT.get(hashed(paths)) or next((m for m in BY_SIZE if hashed(set(paths) & set(m.paths)) == hashed(m.paths)), None)
    if found is None:
        raise ValueError(f"no mapping for a layout of {paths}")
    return found


def _role(role: Column, m: Mapping) -> Column:
    role = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    for name, means in m.roles:
        role = F.when(role == name, F.lit(means)).otherwise(role)
    return role


def _turns(m: Mapping, column) -> Column:
    """Canonical turns by a mapping; column(name) gives a top-level field. What isn't text is cast to it."""
    plain = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    if m.items:
        items, role, text = m.items
        made = F.transform(column(items), lambda x: F.struct(_role(x[role].cast("string"), m).alias("role"), plain(x[text]).alias("text")))
        return F.coalesce(made, F.array().cast(TURNS))
    made = [F.struct(F.lit(role).alias("role"), plain(column(name)).alias("text")) for role, name in m.fields]
    kept = [F.when(turn["text"] != "", turn) if name in m.optional else turn for turn, (_, name) in zip(made, m.fields, strict=True)]
    return F.filter(F.array(*kept), lambda x: x.isNotNull()).cast(TURNS)


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a table in any known layout. Turn rows are gathered by key, in order of turn, then role and
    text on ties; null roles and texts are empty. Repeated rows are turns of their own. A null key says nothing about
    what belongs together: each such row is a conversation of its own. Other columns are ignored, whatever they are
    called. Empty table: empty result. One conversation is one row, under the engine's limit of 2 GB a row."""
    m, rows = mapping_of(df), numbered(df)
    column = lambda name: F.col(f"c{position(df, name)}")
    if m.items or m.fields:
        return rows.select(column(key), _turns(m, column).alias("turns")).toDF(key, "turns")
    said = F.struct(column("turn").alias("turn"), F.coalesce(column("role").cast("string"), F.lit("")).alias("role"), F.coalesce(column("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(column(key).alias("key"), said.alias("said"))
    grouped = rows.filter("key is not null").groupBy("key").agg(F.sort_array(F.collect_list("said")).alias("t"))
    both = grouped.unionByName(rows.filter("key is null").select("key", F.array("said").alias("t")))
    return both.select("key", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")).toDF(key, "turns")


def _json_schema(m: Mapping) -> str:
    if m.items:
        items, role, text = m.items
        return f"`{items}` array<struct<`{role}`:string,`{text}`:string>>"
    return ", ".join(f"`{name}` string" for _, name in m.fields)


def json_paths(value: Column) -> Column:
    """Sorted distinct field paths of a JSON text, one and two levels deep, without names that no mapping knows."""
    known = F.array(*[F.lit(x) for x in sorted(KNOWN_NAMES)])
    top = F.filter(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), lambda k: F.array_contains(known, k))
    fields = F.from_json(value, "map<string,string>")

    def nested(name: Column) -> Column:
        items = F.coalesce(F.from_json(F.element_at(fields, name), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
        names = F.array_distinct(F.flatten(F.transform(items, lambda i: F.coalesce(F.map_keys(i), F.array().cast("array<string>")))))
        return F.transform(F.filter(names, lambda k: F.array_contains(known, k)), lambda k: F.concat(name, F.lit("[]."), k))

    inside = F.flatten(F.transform(F.filter(top, lambda k: F.element_at(fields, k).startswith("[")), nested))
    return F.array_sort(F.array_distinct(F.concat(top, inside)))


def canonical_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, turns, layout) of JSON records in mixed layouts, each by its own fingerprint, as for tables; turns and layout
    are null where no mapping knows it, or the text isn't JSON or null. Other columns of df are ignored."""
    rows = numbered(df).select(F.col(f"c{position(df, key)}").alias("key"), F.col(f"c{position(df, value)}").alias("value"))
    prints = rows.withColumn("paths", json_paths(F.col("value")))
    digest = lambda paths: F.sha2(F.concat_ws("\n", paths), 256)
    layout = F.lit(None).cast("string")
    for m in reversed(BY_SIZE):  # what is said last counts first
        if m.items or m.fields:
            wanted = F.array(*[F.lit(x) for x in sorted(m.paths)])
            layout = F.when(digest(F.array_sort(F.array_intersect("paths", wanted))) == hashed(m.paths), F.lit(m.name)).otherwise(layout)
    for print_, m in BY_FINGERPRINT.items():
        if m.items or m.fields:
            layout = F.when(digest(F.col("paths")) == print_, F.lit(m.name)).otherwise(layout)
    known = prints.withColumn("layout", layout)
    turns = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if m.items or m.fields:
            here = F.from_json("value", _json_schema(m))
            turns = F.when(F.col("layout") == m.name, _turns(m, lambda name, here=here: here[name])).otherwise(turns)
    return known.select("key", turns.alias("turns"), "layout").toDF(key, "turns", "layout")


def escape(text: Column) -> Column:
    """One more backslash inside every <|, <\\|, <\\\\| ...; no control string is left, and unescape() takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)  # at escaped backslashes; what is left of \n is a line end
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss_mask): the text with marks, and for each turn whether its text is trained on.

    No turns, or null: an empty text and an empty mask.
    """
    turns = F.coalesce("turns", F.array().cast(TURNS))
    one = lambda x: F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END))
    return conversations.select(key, F.array_join(F.transform(turns, one), "").alias("formatted"), F.transform(turns, lambda x: x["role"] == TRAINED_ROLE).alias("loss_mask"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, turns of role, text, loss), parsed from the formatted text and its loss mask alone."""
    marked = F.split("formatted", re.escape(START), -1)
    pieces = F.slice(marked, F.lit(2), F.size(marked) - 1)

    def turn(piece: Column, loss: Column) -> Column:
        at = F.instr(piece, "\n")
        text = F.substring(piece, at + 1, F.length(piece) - at - len(END))
        return F.struct(_unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"), loss.alias("loss"))

    return formatted.select(key, "formatted", F.zip_with(pieces, "loss_mask", turn).alias("turns"))


def loss_spans(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, start, end): code-point spans of the trained texts inside the formatted text, in order."""
    marked = F.split("formatted", re.escape(START), -1)
    flat = formatted.select(key, F.posexplode(F.arrays_zip(F.slice(marked, F.lit(2), F.size(marked) - 1).alias("piece"), F.col("loss_mask").alias("loss"))).alias("at", "x"))
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.piece") + len(START)).over(so_far) - len(END)
    placed = flat.select(key, "x.loss", (end - F.length("x.piece") + len(END) + F.instr("x.piece", "\n")).alias("start"), end.alias("end"))
    return placed.filter("loss").select(key, "start", "end")


def digest(read: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation: turns, hash of all turns, characters and hash of what is trained on, formatted characters."""
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return read.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
