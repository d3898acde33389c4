r"""Chat formatting: records of any known layout become canonical turns, then one marked text.

A layout's schema fingerprint is the hash of the nested field paths that it needs; a record's or
table's is that of the layout with most paths among its own, whatever else it holds. A table of
declarative mappings, keyed by fingerprint, says where the turns are; a layout that is not in
the table is reported, not guessed.

The template writes a turn as ``### role LF text </turn> LF``. Inside roles and texts the
escape character ``\`` is doubled and one is put inside each control string (``<\/turn>``, and
after each ``#`` that two more follow), so no control string stands in an escaped text, however
long a run of ``#``, and unescaping is exact. In roles a line end is written ``\n``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Layout name -> (example record whose field paths make the fingerprint, turns as a declarative mapping).
#: A mapping is a list of (role, field) for single turns or (array field, role field, text field) for lists. A field
#: with a question mark makes no turn if it is empty. Of layouts with as many paths the first here holds.
LAYOUTS: dict[str, tuple[dict, list[tuple]]] = {
    "messages": ({"messages": [{"role": "", "content": ""}]}, [("messages", "role", "content")]),
    "conversations": ({"conversations": [{"from": "", "value": ""}]}, [("conversations", "from", "value")]),
    "prompt_completion": ({"prompt": "", "completion": ""}, [("user", "prompt"), ("assistant", "completion")]),
    "prompt_response": ({"prompt": "", "response": ""}, [("user", "prompt"), ("assistant", "response")]),
    "system_prompt_response": ({"system": "", "prompt": "", "response": ""}, [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "question_answer": ({"question": "", "answer": ""}, [("user", "question"), ("assistant", "answer")]),
    "instruction_output": ({"instruction": "", "output": ""}, [("user", "instruction"), ("assistant", "output")]),
    "instruction_input_output": ({"instruction": "", "input": "", "output": ""}, [("user", "instruction"), ("user", "input?"), ("assistant", "output")]),
}

#: Layouts of tables with a row a turn: (example row, (conversation, order, role and text column)).
ROW_LAYOUTS: dict[str, tuple[dict, tuple[str, str, str, str]]] = {
    "turn_rows": ({"conv_id": 0, "turn": 0, "role": "", "text": ""}, ("conv_id", "turn", "role", "text")),
}

#: Other names of the same roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, path: str = "") -> list[str]:
    """The nested field paths of an example, in order: ``messages[].role`` and so on."""
    if isinstance(value, dict):
        return sorted(p for k, v in value.items() for p in field_paths(v, f"{path}.{k}" if path else k))
    if isinstance(value, list):
        return sorted({p for v in value for p in field_paths(v, path + "[]")}) or [path + "[]"]
    return [path]


def schema_paths(kind: T.DataType, path: str = "") -> list[str]:
    """The nested field paths of a column type or of a table's schema."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, path + "[]")
    return [path]


def json_paths(record: Column) -> Column:
    """The field paths of a JSON record, two levels deep, which is as deep as the layouts go."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def under(k: Column) -> Column:
        inner = F.from_json(F.get(F.map_values(F.map_filter(F.from_json(record, "map<string,string>"), lambda n, _: n == k)), 0), "array<string>")
        names = F.array_distinct(F.flatten(F.transform(inner, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))))
        return F.when(F.size(names) > 0, F.transform(names, lambda n: F.concat(k, F.lit("[]."), n))).otherwise(F.array(k))

    return F.sort_array(F.flatten(F.transform(keys, under)))


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def path_hash(paths: list[str]) -> str:
    """``fingerprint`` of paths that are known."""
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def by_width(layouts: dict[str, tuple]) -> list[tuple[str, list[str], object]]:
    """(name, paths, mapping) of layouts, those that need most paths first."""
    return sorted(((name, field_paths(example), mapping) for name, (example, mapping) in layouts.items()), key=lambda x: -len(x[1]))


def needed_paths(paths: Column) -> Column:
    """Of a record's paths those that its layout needs; all of them if no layout has all it needs."""
    out = paths
    for _, wanted, _ in reversed(by_width(LAYOUTS)):
        want = F.array(*map(F.lit, wanted))
        out = F.when(F.size(F.array_except(want, paths)) == 0, want).otherwise(out)
    return out


def _turns(record: Column, mapping: list[tuple]) -> Column:
    parts = []
    for m in mapping:
        if len(m) == 3:
            kind = f"struct<`{m[0]}`:array<struct<`{m[1]}`:string,`{m[2]}`:string>>>"
            found = F.from_json(record, kind)[m[0]]
            names = (m[1], m[2])
            parts.append(F.transform(F.coalesce(found, F.array().cast(f"array<struct<`{names[0]}`:string,`{names[1]}`:string>>")), _turn_reader(names)))
        else:
            text = F.coalesce(F.get_json_object(record, f"$.{m[1].rstrip('?')}"), F.lit(""))
            turn = F.array(F.struct(F.lit(m[0]).alias("role"), text.alias("text")))
            parts.append(F.when(F.length(text) > 0, turn).otherwise(F.array().cast(TURNS)) if m[1].endswith("?") else turn)
    return F.concat(*parts)


def _turn_reader(names: tuple[str, str]) -> Callable[[Column], Column]:
    return lambda x: F.struct(canonical_role(x[names[0]]).alias("role"), F.coalesce(x[names[1]], F.lit("")).alias("text"))


def canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), role, F.lit(""))


def canonical_turns(records: DataFrame, json_column: str) -> DataFrame:
    """``records`` with layout (null if unknown) and turns, by the fingerprint of each JSON record.

    Null, broken and unknown records get no turns and a null layout.
    """
    record = F.col(json_column)
    out = records.withColumn("fingerprint", fingerprint(needed_paths(json_paths(record))))
    names, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, paths, mapping in by_width(LAYOUTS):
        mine = F.col("fingerprint") == path_hash(paths)
        names, turns = F.when(mine, name).otherwise(names), F.when(mine, _turns(record, mapping)).otherwise(turns)
    return out.select("*", names.alias("layout"), turns.alias("turns"))


def row_mapping(paths: list[str]) -> tuple[str, str, str, str]:
    """The mapping that the fingerprint of a table's paths selects."""
    layouts = by_width(ROW_LAYOUTS)
    mappings = {path_hash(wanted): mapping for _, wanted, mapping in layouts}
    mine = path_hash(next((wanted for _, wanted, _ in layouts if set(wanted) <= set(paths)), paths))
    if mine not in mappings:
        raise ValueError(f"not a table of turns: {json.dumps(paths)}")
    return mappings[mine]


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with a row a turn; the fingerprint of its schema selects the mapping.

    Turns are in the order of turn, role, text; nulls come first. A null text or role is empty,
    null conv_ids are one conversation, rows that repeat are turns of their own.
    """
    conversation, order, role, text = row_mapping(schema_paths(rows.schema))
    one = F.struct(F.col(order).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conversation).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>")), "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A line end's mark is an "n" after an odd number of escape characters.
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_turns(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Adds formatted and loss_spans, the (start, length) in code points, from 0, of each text of ``trained_role``."""
    marked = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("### "), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    out = conversations.withColumn("_marked", marked)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + F.length(m["head"])
        span = F.array(F.struct(begin.alias("start"), F.length(m["body"]).alias("length")))
        return F.struct((begin + F.length(m["body"]) + len(TURN_END)).alias("at"), F.when(m["role"] == trained_role, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    text = F.array_join(F.transform("_marked", lambda m: F.concat(m["head"], m["body"], F.lit(TURN_END))), "")
    return out.select("conv_id", text.alias("formatted"), F.aggregate("_marked", start, step, lambda a: a["spans"]).alias("loss_spans"))


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Reads turns and the unescaped texts under the loss mask back from the formatted text."""
    pieces = F.filter(F.split("formatted", TURN_END), lambda p: p.startswith("### "))
    turns = F.transform(pieces, lambda p: F.struct(unescape_role(F.substring_index(F.substr(p, F.lit(5)), "\n", 1)).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))
    return formatted.select("*", turns.alias("turns"), F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, all read back from the output."""
    back = parse_formatted(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


PLANTED = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """The digest of every conversation and of conversation -7; edge cases are those of ``turns_of_rows``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digest(format_turns(turns_of_rows(rows.unionByName(planted, allowMissingColumns=True))))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS lt,
             length(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), chr(10), '\n')) + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0) AS lr FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + lr + 1 + lt + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
