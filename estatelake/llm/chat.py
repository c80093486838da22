"""Chat formatting: records of any known layout become canonical turns, and turns become one text with a loss mask.

The nested field paths of a JSON record are hashed; the hash selects a declarative mapping. The template closes every turn with
a control string, and control strings inside texts are broken up reversibly, so a formatted text can be read back exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark's JSON reader refuses longer strings than 20,000,000 characters unless told otherwise.
JSON = {"maxStringLen": "2147483647"}
TURNS = "array<struct<role:string,text:string>>"

# Layouts by name. ``list`` names a field of messages with a role and a text field; ``turns`` names the role and the fields of
# each turn, whose non-empty texts are joined by a blank line. A turn whose fields are all missing is left out.
LAYOUTS = {
    "messages": {"list": ("messages", "role", "content")},
    "message_texts": {"list": ("messages", "role", "text")},
    "conversations": {"list": ("conversations", "from", "value")},
    "dialogue": {"list": ("dialogue", "speaker", "utterance")},
    "prompt_completion": {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "system_prompt_response": {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction_output": {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input_output": {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question_answer": {"turns": [("user", ["question"]), ("assistant", ["answer"])]},
}
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Opening and closing control string of each role; any other role is written out between [ROLE] and [TEXT].
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
_INNER = r"([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|ROLE\]|/?TEXT\])"
_CLOSED = r"(?<=</s>|\[/SYS\]|\[/INST\]|\[/TEXT\])"


def _paths(layout: dict) -> list[str]:
    if "list" in layout:
        field, role, text = layout["list"]
        return sorted([field, f"{field}[].{role}", f"{field}[].{text}"])
    return sorted(f for _, fields in layout["turns"] for f in fields)


def field_paths(record: Column) -> Column:
    """Sorted distinct nested field paths of a JSON object: ``a``, ``a.b`` for objects in it, ``a[].b`` for lists of objects."""
    top = F.from_json(record, "map<string,string>", JSON)
    lists = lambda v: F.flatten(F.transform(F.from_json(v, "array<map<string,string>>", JSON), lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))))
    below = F.transform(
        F.map_entries(top),
        lambda e: F.when(F.ltrim(e.value).startswith("["), F.transform(F.array_distinct(lists(e.value)), lambda k: F.concat(e.key, F.lit("[]."), k)))
        .when(F.ltrim(e.value).startswith("{"), F.transform(F.map_keys(F.from_json(e.value, "map<string,string>", JSON)), lambda k: F.concat(e.key, F.lit("."), k))),
    )
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(
        F.coalesce(F.map_keys(top), none), F.flatten(F.transform(F.coalesce(below, F.array().cast("array<array<string>>")), lambda b: F.coalesce(b, none)))
    )))


def fingerprint(paths: Column, layouts: dict = LAYOUTS) -> Column:
    """Hash of those paths that some layout uses, so that further fields of a record do no harm."""
    used = sorted({p for layout in layouts.values() for p in _paths(layout)})
    return F.xxhash64(F.array_join(F.array_intersect(paths, F.array(*map(F.lit, used))), "\n"))


def _mapped(record: Column, layout: dict) -> Column:
    if "list" in layout:
        field, role, text = layout["list"]
        items = F.from_json(record, f"struct<`{field}`:array<struct<`{role}`:string,`{text}`:string>>>", JSON)[field]
        names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
        return F.transform(
            F.filter(items, lambda m: m.isNotNull()),
            lambda m: F.struct(F.coalesce(names[m[role]], m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")),
        )
    values = F.from_json(record, "map<string,string>", JSON)
    turns = []
    for role, fields in layout["turns"]:
        texts = [values[f] for f in fields]
        joined = F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n")
        turns.append(F.when(F.coalesce(*texts).isNotNull(), F.struct(F.lit(role).alias("role"), joined.alias("text"))))
    return F.array_compact(F.array(*turns))


def canonical_turns(records: DataFrame, record: str = "record", layouts: dict = LAYOUTS) -> DataFrame:
    """Adds layout (null if unknown) and turns to every row with a JSON record; columns of these names are replaced.

    Null, broken and unknown records keep their row with no turns. A null text or role counts as empty.
    """
    known = "__fingerprint"
    out = records.withColumn(known, fingerprint(field_paths(F.col(record)), layouts))
    chosen = lambda layout: F.col(known) == fingerprint(F.array(*[F.lit(p) for p in _paths(layout)]), layouts)
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for key, layout in layouts.items():
        name = F.when(chosen(layout), F.lit(key)).otherwise(name)
        turns = F.when(chosen(layout), _mapped(F.col(record), layout).cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": name, "turns": F.coalesce(turns, F.array().cast(TURNS))}).drop(known)


def records_of_rows(rows: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record in the messages layout per conversation of a table with one row per turn.

    Turns come in the order of ``turn`` (null first); rows of the same turn by role and text. A conversation is one value in
    the end, so it has to fit into one row.
    """
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    messages = F.transform(F.array_sort(F.collect_list(item)), lambda m: F.struct(m.role.alias("role"), m.text.alias("content")))
    return rows.groupBy(conversation).agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def escape(text: Column) -> Column:
    """Puts one more backslash behind the first character of every (already broken) control string."""
    return F.regexp_replace(text, _INNER, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _INNER.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _by_role(role: Column, value, other: Column) -> Column:
    return reduce(lambda rest, r: F.when(role == r, value(r)).otherwise(rest), MARKS, other)


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted``, the template's text, and ``loss``, the spans (code points, end exclusive) of the assistant texts in
    it without their control strings. No turns give an empty text. Columns of these names are replaced."""
    opener = lambda t: _by_role(t.role, lambda r: F.lit(MARKS[r][0]), F.concat(F.lit(OTHER[0]), escape(t.role), F.lit(OTHER[1])))
    closer = lambda t: _by_role(t.role, lambda r: F.lit(MARKS[r][1]), F.lit(OTHER[2]))
    parts = F.transform(F.col(turns), lambda t: F.struct(
        opener(t).alias("a"), escape(t.text).alias("b"), closer(t).alias("c"), (t.role == "assistant").alias("loss")
    ))
    out = df.withColumn("__parts", parts)
    span = lambda at, p: F.struct((at + F.length(p.a)).alias("start"), (at + F.length(p.a) + F.length(p.b)).alias("end"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, p: F.struct(
        (acc.at + F.length(p.a) + F.length(p.b) + F.length(p.c)).alias("at"),
        F.when(p.loss, F.array_append(acc.spans, span(acc.at, p))).otherwise(acc.spans).alias("spans"),
    )
    return out.withColumns({
        "formatted": F.array_join(F.transform("__parts", lambda p: F.concat(p.a, p.b, p.c)), ""),
        "loss": F.aggregate("__parts", start, step, lambda acc: acc.spans),
    }).drop("__parts")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text. Control strings in it are live ones only, so it is cut behind every closing one."""
    pieces = F.filter(F.split(formatted, _CLOSED), lambda p: p != "")
    inside = lambda p, a, b: F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))
    known = lambda p: reduce(
        lambda rest, r: F.when(
            p.startswith(MARKS[r][0]), F.struct(F.lit(r).alias("role"), unescape(inside(p, *MARKS[r])).alias("text"))
        ).otherwise(rest),
        MARKS,
        F.struct(
            unescape(F.substring_index(inside(p, OTHER[0], OTHER[2]), OTHER[1], 1)).alias("role"),
            unescape(F.substring(p, F.locate(OTHER[1], p) + len(OTHER[1]), F.length(p) - F.locate(OTHER[1], p) - len(OTHER[1]) + 1 - len(OTHER[2]))).alias("text"),
        ),
    )
    return F.transform(pieces, known)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start + 1, s.end - s.start))), "")
