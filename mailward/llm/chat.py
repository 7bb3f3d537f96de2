"""Chat formatting by schema fingerprints (operator 4), in native expressions only.

A record is a JSON text. Its fingerprint is the hash of its nested fields of any depth, types left out. Each
known layout is declared as the paths that it needs; a table of the distinct fingerprints gives each the first
layout whose paths it holds, and is joined to the records by fingerprint. The layout's mapping turns a record
into canonical turns of role and text. Records of one table may differ in layout and carry fields besides.
Other names of roles (human, gpt, bot, model and the like) become user, assistant or system, in any case of
letters; in ``messages``, whose roles are canonical, and for names not known, roles stay as they are.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. A backslash goes into every control
string inside roles and texts, behind its first character, and every backslash is doubled; so no control
string of a text survives as one, and removing each escaping backslash gives the text back.

No text is too long: the JSON reader's own limit on strings is lifted, and where a record is too large for a
VARIANT its fingerprint is that of its paths alone, which is all that a layout asks for.

Defined results. Null roles and texts count as empty. Turns are in order of turn, then role, then text,
null turns first; repeated rows are turns of their own. A record that fits no layout, or is no JSON, has
no turns and a null layout; ``without_layout`` counts such records by fingerprint. A conversation is one output row, so its turns meet in one task. An empty table gives only the
rows that the query adds. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, maybe_broadcast, table, written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What would end or open a turn, here or in other common templates.
_CONTROL = r"([<\[])(?=/?(?:s>|INST\]|SYS>>|<SYS)|\||<)"
_TURNS = "array<struct<role:string,text:string>>"
#: The reader's limit on a string lifted: a record is refused for no length that a row can have.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Layout:
    """paths a record must have, and the mapping from its parsed form (of the given schema) to turns."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: object


def _turn(role, text) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


_ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "user": "user", "assistant": "assistant", "system": "system"}


def _canonical(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(role))), role)


def _opened(system: Column, turns: Column) -> Column:
    """turns behind a system turn, if there is a system text."""
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(_turn(F.lit("system"), system)), turns)).otherwise(turns)


def _listed(field: str, role: str, text: str, named=_canonical):
    def turns(r):
        listed = F.transform(F.filter(r[field], lambda m: m.isNotNull()), lambda m: _turn(named(m[role]), m[text]))
        return _opened(r["system"], F.coalesce(listed, F.array().cast(_TURNS)))

    return turns


def _pair(user: str, assistant: str, context: str | None = None):
    def turns(r):
        asked = F.concat_ws("\n", r[user], F.nullif(r[context], F.lit(""))) if context else r[user]
        system = F.coalesce(F.nullif(r["system"], F.lit("")), r["system_prompt"])
        return _opened(system, F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), r[assistant])))

    return turns


def _strings(*fields: str) -> str:
    return ", ".join(f"{f} string" for f in (*fields, "system", "system_prompt"))


LAYOUTS = (
    Layout("messages", ("messages", "messages.content", "messages.role"), "messages array<struct<role:string,content:string>>, system string", _listed("messages", "role", "content", lambda role: role)),
    Layout("conversations", ("conversations", "conversations.from", "conversations.value"), "conversations array<struct<from:string,value:string>>, system string", _listed("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), _strings("instruction", "input", "output"), _pair("instruction", "output", "input")),
    Layout("context", ("instruction", "response"), _strings("instruction", "context", "response"), _pair("instruction", "response", "context")),
    Layout("completion", ("prompt", "completion"), _strings("prompt", "completion"), _pair("prompt", "completion")),
    Layout("response", ("prompt", "response"), _strings("prompt", "response"), _pair("prompt", "response")),
    Layout("answer", ("question", "answer"), _strings("question", "context", "answer"), _pair("question", "answer", "context")),
    Layout("question", ("question", "response"), _strings("question", "context", "response"), _pair("question", "response", "context")),
    Layout("flat", ("content", "role"), "role string, content string", lambda r: F.array(_turn(_canonical(r["role"]), r["content"]))),
)

#: A scalar type in the schema of a variant.
_SCALAR = r"(?<=[<:] ?)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DECIMAL\(\d+, ?\d+\))(?=[,>]|$)"


def _fields(record: Column, schema: str) -> Column:
    return F.from_json(record, schema, _ANY_LENGTH)


def field_paths(record: Column) -> Column:
    """Sorted distinct paths of a JSON text's fields, two levels deep, as deep as layouts look; array elements share their array's path."""
    parsed = F.filter(F.map_entries(_fields(record, "map<string,string>")), lambda e: e["key"].isNotNull())

    def inner(e):
        items = F.coalesce(_fields(e["value"], "array<string>"), F.array(e["value"]))
        return F.flatten(F.transform(items, lambda i: F.transform(F.coalesce(F.map_keys(_fields(i, "map<string,string>")), F.array().cast("array<string>")), lambda x: F.concat(e["key"], F.lit("."), x))))

    return F.array_sort(F.array_distinct(F.concat(F.transform(parsed, lambda e: e["key"]), F.flatten(F.transform(parsed, inner)))))


def fingerprint(record: Column, paths: Column) -> Column:
    """Hash of the paths and of the fields below them; a record with repeated keys counts by its paths."""
    fields = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), _SCALAR, "")
    return F.when(paths.isNotNull(), F.xxhash64(F.array_join(paths, "\n"), fields))


def layouts(seen: DataFrame) -> DataFrame:
    """fingerprint, layout, records, example (a record) of each distinct fingerprint of seen(record, __paths, fingerprint)."""
    known = seen.groupBy("fingerprint").agg(F.min("__paths").alias("paths"), F.count(F.lit(1)).alias("records"), F.min("record").alias("example"))
    layout = F.lit(None).cast("string")
    for x in reversed(LAYOUTS):
        fits = F.coalesce(F.size(F.array_intersect("paths", F.array(*[F.lit(p) for p in x.paths]))) == len(x.paths), F.lit(False))
        layout = F.when(fits, F.lit(x.name)).otherwise(layout)
    return known.select("fingerprint", layout.alias("layout"), "records", "example")


def _seen(records: DataFrame) -> DataFrame:
    seen = records.withColumn("__paths", field_paths(F.col("record")))
    return seen.withColumn("fingerprint", fingerprint(F.col("record"), F.col("__paths")))


def _named_seen(records: DataFrame) -> DataFrame:
    return _seen(records.select("record"))


def without_layout(records: DataFrame) -> DataFrame:
    """fingerprint, records, example of each fingerprint that fits no layout; null for what is no JSON object."""
    return layouts(_named_seen(records)).filter("layout is null").drop("layout")


def canonical_turns(records: DataFrame) -> DataFrame:
    """records (record, ...) with fingerprint, layout and turns added; columns called so before give way, all others pass through."""
    own = [c for c in records.columns if c.lower() not in ("fingerprint", "layout", "turns")]
    aside = {c: fresh("own_paths", records.columns) for c in own if c.lower() == "__paths"}
    seen = written(_seen(records.select(*own).withColumnsRenamed(aside)), "records")
    known = written(layouts(seen).select("fingerprint", "layout"), "layouts")
    seen = seen.drop("__paths").join(maybe_broadcast(known, known.count(), 64), "fingerprint", "left")
    turns = F.array().cast(_TURNS)
    for x in reversed(LAYOUTS):
        turns = F.when(F.col("layout") == x.name, F.coalesce(x.turns(_fields(F.col("record"), x.schema)), F.array().cast(_TURNS))).otherwise(turns)
    return seen.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in own], "fingerprint", "layout", turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(turns: Column) -> Column:
    """The canonical turns under the template."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END))), "")


def _split(text: Column) -> Column:
    """[role, text] of each turn of a formatted text, still escaped."""
    turns = F.filter(F.split(text, r"<\|end\|>"), lambda t: t != "")
    return F.transform(turns, lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    return F.transform(_split(text), lambda t: F.struct(unescaped(t[0]).alias("role"), unescaped(t[1]).alias("text")))


def loss_spans(text: Column) -> Column:
    """(start, length), in code points from 0, of every assistant text of a formatted text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    frame = len(TURN) + len(TEXT)

    def add(acc, t):
        start, size = acc["at"] + frame + F.length(t[0]), F.length(t[1])
        mine = F.when(t[0] == "assistant", F.array(F.struct(start.alias("start"), size.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((start + size + len(END)).alias("at"), F.concat(acc["spans"], mine).alias("spans"))

    return F.aggregate(_split(text), zero, add)["spans"]


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id, record: each conversation of rows(conv_id, turn, role, text) as a record of messages."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    messages = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def format_chats(records: DataFrame) -> DataFrame:
    """records (record, ...) with fingerprint, layout, formatted and loss_spans; turns are left out."""
    found = canonical_turns(records)
    shown = found.withColumn("formatted", formatted(F.col("turns"))).drop("turns")
    return shown.withColumn("loss_spans", loss_spans(F.col("formatted")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    done = format_chats(conversation_records(rows.withColumn("turn", F.col("turn").cast("long")).unionByName(extra)))
    back = parsed(F.col("formatted"))
    mask = F.array_join(F.transform("loss_spans", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    read = done.select("conv_id", "formatted", "layout", back.alias("turns"), mask.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_MARK = r"^[<\[](/?(s>|INST\]|SYS>>|<SYS)|\||<)"
_LONG = f"length({{x}}) + length({{x}}) - length(replace({{x}}, '\\', '')) + len([1 FOR i IN range(1, length({{x}}) + 1) IF regexp_matches(substr({{x}}, i, 8), '{_MARK}')])"
SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (SELECT *, {_LONG.format(x="role")} + {_LONG.format(x="text")} + {len(TURN + TEXT + END)} AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

QUERIES = {"op4_chat": op4_chat}
ORACLES = {"op4_chat": SQL}
