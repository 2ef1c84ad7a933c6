"""Chat formatting: records of any known layout become canonical turns, and turns become a marked, reversible text.

A record is JSON, or columns. Its schema fingerprint is a hash of its nested field paths (`schema_of_variant`, without the types of leaves; of
columns, their schema), and the fingerprint selects a declarative mapping: where the turns are, and which fields are a turn's role and text. Layouts are data; a
new one is a new row of `LAYOUTS`, and layouts that differ in leaf types or nulls are one.

The template marks each turn as `<|turn|>role<|text|>text<|end|>`. Control strings of common templates inside roles and texts
get a backslash after their first character (one more where there are some already), so none is left, and taking one away
restores the text. A turn is a segment, a row of its own; a conversation's text is its segments in order, and the loss mask of an
assistant's segment covers its escaped text. Nothing gathers a conversation, so that of any length fits.

Defined results: null texts and roles are empty; turns that tie are ordered by their segments; a record whose layout is
unknown or that is no JSON has no turns and comes back from `unmapped`, and so does a JSON string of more than 20,000,000 characters,
Spark's limit; records that are columns take `column_turns`, which has no such limit; rows with a null id are one conversation; an empty
table gives no rows. A conversation numbered -1 in the query's table and the one it adds are one.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First character, then the rest, of every control string of the templates in common use.
CONTROL = r"(<|\[)({0})(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
ESCAPE, UNESCAPE = CONTROL.format(r"\\*"), CONTROL.format(r"\\+")

#: name, an example of the layout, and turns as (path of an array of turns or None, [(role, or its field; text field)]).
#: A role that starts with "=" is that role; else it is the field that holds it.
LAYOUTS = (
    ("row", '{"turn": 1, "role": "", "text": ""}', None, [("role", "text")]),
    ("messages", '{"messages": [{"role": "", "content": ""}]}', "messages", [("role", "content")]),
    ("conversations", '{"conversations": [{"from": "", "value": ""}]}', "conversations", [("from", "value")]),
    ("instruction", '{"instruction": "", "input": "", "output": ""}', None, [("=system", "instruction"), ("=user", "input"), ("=assistant", "output")]),
    ("bare instruction", '{"instruction": "", "output": ""}', None, [("=user", "instruction"), ("=assistant", "output")]),
    ("prompt", '{"prompt": "", "completion": ""}', None, [("=user", "prompt"), ("=assistant", "completion")]),
    ("prompt response", '{"prompt": "", "response": ""}', None, [("=user", "prompt"), ("=assistant", "response")]),
    ("question", '{"question": "", "answer": ""}', None, [("=user", "question"), ("=assistant", "answer")]),
)
#: What layouts whose role field is `from` call the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(record: Column) -> Column:
    """64-bit hash of the nested field paths of a VARIANT; leaf types don't count."""
    paths = F.regexp_replace(
        F.schema_of_variant(record), r"\b(?:STRING|BIGINT|VOID|DOUBLE|FLOAT|BOOLEAN|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY)\b(?=[,>]|$)", "_"
    )
    return F.xxhash64(paths)


def to_turns(records: DataFrame, id_col: str, json_col: str, order_cols: list[str] = (), layouts=LAYOUTS) -> DataFrame:
    """(id, place, at, role, text): the canonical turns of JSON records. `place` are the record's `order_cols` as a struct (for
    layouts of one turn a record), `at` the place in the record."""
    spark = records.sparkSession
    known = spark.createDataFrame([(name, example) for name, example, _, _ in layouts], "layout string, example string")
    known = {r["layout"]: r["f"] for r in known.select("layout", fingerprint(F.parse_json("example")).alias("f")).collect()}
    record = F.try_parse_json(F.col(f"`{json_col}`"))
    base = records.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.struct(*[F.col(f"`{c}`") for c in order_cols]) if order_cols else F.struct(F.lit(0).alias("none"))).alias("place"),
        record.alias("r"),
    ).withColumn("f", fingerprint(F.col("r")))
    text = lambda v, path: F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))

    def turn(v: Column, role: str, field: str) -> Column:
        said = F.lit(role[1:]) if role.startswith("=") else text(v, role)
        named = said
        if role == "from":
            for other, canonical in ROLES.items():
                named = F.when(said == other, F.lit(canonical)).otherwise(named)
        return F.struct(named.alias("role"), text(v, field).alias("text"))

    def partial_turn(role: str, field: str):
        return lambda v: turn(v, role, field)

    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for name, _, path, fields in layouts:
        if path:
            made = F.transform(F.try_variant_get("r", f"$.{path}", "array<variant>"), partial_turn(*fields[0]))
        else:
            made = F.array(*[turn(F.col("r"), *f) for f in fields])
        turns = F.when(F.col("f") == known[name], made).otherwise(turns)
    return base.withColumn("turns", turns).select("id", "place", F.posexplode_outer("turns").alias("at", "t")).select(
        "id", "place", "at", "t.role", "t.text"
    )


def schema_paths(kind: T.DataType) -> str:
    """The nested field paths of a column type, as `fingerprint` sees them in a VARIANT."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {schema_paths(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name.encode())) + ">"
    return f"ARRAY<{schema_paths(kind.elementType)}>" if isinstance(kind, T.ArrayType) else "_"


def column_turns(rows: DataFrame, id_col: str, order_cols: list[str] = (), fields: list[str] | None = None, layouts=LAYOUTS) -> DataFrame:
    """`to_turns` of records that are columns, `fields` of `rows` or all but `id_col`. Their schema's fingerprint, the same that such a record has
    as JSON, selects the mapping, once for all rows; it is applied to the columns themselves, so texts of any length are kept. Columns of no
    known layout are refused."""
    fields = fields or [c for c in rows.columns if c != id_col]
    record = T.StructType([rows.schema[c] for c in fields])
    spark = rows.sparkSession
    known = spark.createDataFrame([(name, example) for name, example, _, _ in layouts], "layout string, example string")
    own = F.xxhash64(F.lit(schema_paths(record)))
    found = known.where(fingerprint(F.parse_json("example")) == own).select("layout").collect()
    if not found:
        raise ValueError(f"no layout is known for {schema_paths(record)}")
    _, _, path, mapped = next(x for x in layouts if x[0] == found[0]["layout"])
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def turn(at, role: str, text: str) -> Column:
        named = F.lit(role[1:]) if role.startswith("=") else said(at(role))
        if role == "from":
            for other, canonical in ROLES.items():
                named = F.when(said(at(role)) == other, F.lit(canonical)).otherwise(named)
        return F.struct(named.alias("role"), said(at(text)).alias("text"))

    column = lambda c: F.col(f"`{c}`")
    turns = F.transform(column(path), lambda m: turn(lambda c: m[c], *mapped[0])) if path else F.array(*[turn(column, *f) for f in mapped])
    place = F.struct(*[column(c) for c in order_cols]) if order_cols else F.struct(F.lit(0).alias("none"))
    made = rows.select(column(id_col).alias("id"), place.alias("place"), F.posexplode_outer(turns).alias("at", "t"))
    return made.select("id", "place", "at", "t.role", "t.text")


def unmapped(turns: DataFrame) -> DataFrame:
    return turns.where("at is null")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def segments(turns: DataFrame) -> DataFrame:
    """`turns` with `segment` and the loss mask in it: code points [loss_start, loss_end), null where nothing is learned."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    start = F.lit(len(TURN) + len(TEXT)) + F.char_length(role)
    learned = F.col("role") == "assistant"
    return turns.where("at is not null").select(
        "id",
        "place",
        "at",
        F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("segment"),
        F.when(learned, start).cast("long").alias("loss_start"),
        F.when(learned, start + F.char_length(text)).cast("long").alias("loss_end"),
    )


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, lambda m: m[1] + m[2][1:] + m[3], text)


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError(f"no segment: {segment[:40]!r}")
    role, text = segment[len(TURN) : -len(END)].split(TEXT)
    return unescape(role), unescape(text)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation, from its segments alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Segments stream in order through running digests; a task holds one batch of rows at a time."""

    def run(frames):
        held, state = None, None

        def closed():
            n, turns, chars, loss, size = state
            return (held, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for frame in frames:
            out = []
            for conv, segment, start, end in zip(frame["id"], frame["segment"], frame["loss_start"], frame["loss_end"], strict=True):
                if state is None or conv != held:
                    if state:
                        out.append(closed())
                    held, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start == start and start is not None:
                    learned = unescape(segment[int(start) : int(end)])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        if state:
            yield pd.DataFrame([closed()], columns=COLUMNS)

    dealt = formatted.repartition(F.col("id")).sortWithinPartitions("id", "place", "at", "segment")
    read = dealt.select(F.col("id").cast("string"), "segment", "loss_start", "loss_end").mapInPandas(  # as strings, ids are exact beside nulls
        run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return read.withColumn("conv_id", F.col("conv_id").cast(formatted.schema["id"].dataType))


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations, and one whose texts hold control strings, in another layout."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.to_json(
            F.struct(
                F.array(
                    *[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]
                ).alias("messages")
            )
        ).alias("record"),
    )
    turns = column_turns(rows, "conv_id", ["turn"]).unionByName(to_turns(extra, "conv_id", "record", ["turn"]))
    return read_back(segments(turns))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS er,
         regexp_replace(text, '(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS et FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, er, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
