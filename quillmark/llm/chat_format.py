"""Chat formatting: canonical turns from differently shaped tables, one marked text per conversation, and back.

A table's nested field paths are hashed; the hash selects a declarative mapping that says where roles and texts lie.
Where columns of several layouts stand side by side, and for JSON payloads, each row goes by the layout that it fills.
Everything is DataFrame expressions.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline, for each turn. Inside texts every ``<``, any
number of backslashes, ``|`` gets one more backslash, so no control string is left in them and the way back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import spread, table, written

START, END = "<|im_start|>", "<|im_end|>"


def nested_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves: fields by dots, elements of arrays by []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return nested_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """A known shape: the paths that identify it, and its turns.

    turns is None for one row per turn; else it gives an array of (role, text) for a row that is a conversation, from a
    function that resolves a path to a column.
    """

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column] | None = None
    conversation: str = "conv_id"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _pair(user: str, assistant: str, more: str | None = None) -> Callable:
    def turns(at: Callable[[str], Column]) -> Column:
        asked = at(user).cast("string")
        if more:
            extra = F.coalesce(at(more).cast("string"), F.lit(""))
            whole = F.concat(F.coalesce(asked, F.lit("")), F.when(extra != "", F.concat(F.lit("\n"), extra)).otherwise(""))
            asked = F.when(asked.isNotNull() | at(more).isNotNull(), whole)
        return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), at(assistant)))

    return turns


def _messages(array: str, role: str, text: str) -> Callable:
    names = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

    def turns(at: Callable[[str], Column]) -> Column:
        def one(m: Column) -> Column:
            said = m[role].cast("string")
            for old, new in names.items():
                said = F.when(said == old, new).otherwise(said)
            return _turn(said, m[text])

        return F.transform(at(array), one)

    return turns


LAYOUTS = (
    Layout("rows_by_turn", ("conv_id", "role", "text", "turn")),
    Layout("messages", ("messages[].content", "messages[].role"), _messages("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("instruction_input", ("input", "instruction", "output"), _pair("instruction", "output", "input")),
)
BY_PRINT = {fingerprint(list(x.paths)): x for x in LAYOUTS}
_KNOWN = {p for x in LAYOUTS for p in x.paths}


def select_layout(schema: T.StructType) -> Layout:
    """The layout whose fingerprint the table has; paths that no layout knows are left out of it.

    When columns of two layouts stand side by side, the layout with most paths that is there in full is taken.
    """
    paths = [p for p in nested_paths(schema) if p in _KNOWN]
    if found := BY_PRINT.get(fingerprint(paths)):
        return found
    whole = sorted((x for x in LAYOUTS if set(x.paths) <= set(paths)), key=lambda x: (-len(x.paths), x.name))
    if not whole:
        raise ValueError(f"no layout has the fields {sorted(nested_paths(schema))}")
    return whole[0]


def _tops(layout: Layout) -> list[str]:
    return sorted({p.split("[")[0] for p in layout.paths})


def _filled(layouts: list[Layout], turns: dict[str, Column], may: dict[str, Column] | None = None) -> Column:
    """(name, turns) of the first layout that a row fills throughout, or else in part; null where it fills none.

    A part of a pair is a text of it, as its roles are given; a list is filled by any turn. may says where a layout counts.
    """

    def hit(x: Layout, throughout: bool) -> Column:
        said = turns[x.name]
        if throughout:
            full = (F.size(said) > 0) & F.forall(said, lambda t: t["text"].isNotNull())
        else:
            full = F.size(said) > 0 if "[]" in x.paths[0] else F.exists(said, lambda t: t["text"].isNotNull() | (t["role"].isNotNull() if x.turns is None else F.lit(False)))
        return full & may[x.name] if may else full

    kind = "struct<name:string,turns:array<struct<role:string,text:string>>>"
    one = lambda x: F.struct(F.lit(x.name).alias("name"), turns[x.name].alias("turns")).cast(kind)
    return F.coalesce(*[F.when(hit(x, t), one(x)) for t in (True, False) for x in layouts])


def canonical_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text from any known layout.

    In a table without a conv_id column each row is a conversation of its own: rows are numbered, and written once so that a
    task that runs again meets the same numbers.

    Where the columns of several layouts are there in full, as in a union of sources, each row goes by the one it fills.
    A row that fills none gives one row with null turn, role and text, so that nothing is lost unseen.
    """
    main = select_layout(df.schema)
    paths = set(nested_paths(df.schema))
    layouts = sorted((x for x in LAYOUTS if set(x.paths) <= paths), key=lambda x: (-len(x.paths), x.name))
    if main.turns is None and len(layouts) == 1:
        return spread(df, "conv_id", "turn", "role", "text")
    names = {f.name.lower(): f.name for f in df.schema.fields}
    at = lambda path: F.col(f"`{names[path]}`")
    if "conv_id" not in names:
        needed = sorted({names[p] for x in layouts for p in _tops(x)})
        df = written(df.select(F.monotonically_increasing_id().alias("conv_id"), *[F.col(f"`{c}`") for c in needed]), "chat-numbered")
        names = {f.name.lower(): f.name for f in df.schema.fields}
    key = at("conv_id")
    said = {x.name: x.turns(at) if x.turns else F.array(_turn(at("role"), at("text"))) for x in layouts}
    own = at("turn").cast("long") if main.turns is None else F.lit(None).cast("long")
    rows = df.select(key.alias("conv_id"), own.alias("own"), _filled(layouts, said).alias("found"))
    flat = rows.select("conv_id", "own", F.col("found.name").alias("name"), F.posexplode_outer("found.turns").alias("at", "said"))
    turn = F.when(F.col("name") == "rows_by_turn", F.col("own")).otherwise(F.col("at").cast("long"))
    return flat.select("conv_id", turn.alias("turn"), "said.role", "said.text")


#: All that a JSON value of any layout may hold.
_JSON = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<from:string,value:string>>,prompt:string,response:string,completion:string,instruction:string,input:string,output:string>"


def json_turns(df: DataFrame, key: str, payload: str) -> DataFrame:
    """conv_id, layout, turn, role, text from a column of JSON values of mixed layouts.

    A value has a layout when it has all its keys, whatever other keys or nulls are there. A value of no known layout, or
    that isn't JSON, gives one row with null layout, turn, role and text, so that nothing is lost unseen.
    """
    layouts = sorted((x for x in LAYOUTS if x.turns), key=lambda x: (-len(x.paths), x.name))
    keys = F.when(F.try_parse_json(F.col(payload)).isNotNull(), F.json_object_keys(F.col(payload)))
    read = df.select(F.col(key).alias("conv_id"), keys.alias("keys"), F.from_json(F.col(payload), _JSON).alias("value"))
    may = {x.name: F.coalesce(F.size(F.array_intersect("keys", F.array(*map(F.lit, _tops(x))))) == len(_tops(x)), F.lit(False)) for x in layouts}
    found = read.select("conv_id", _filled(layouts, {x.name: x.turns(lambda path: F.col("value")[path]) for x in layouts}, may).alias("found"))
    flat = found.select("conv_id", F.col("found.name").alias("layout"), F.posexplode_outer("found.turns").alias("turn", "said"))
    return flat.select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), "said.role", "said.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles also give up their newlines, as a newline ends a role."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points of formatted; from 0) for each conversation.

    turns has conv_id, turn, role, text. Turns go by turn (null first), then role, then text; null role and text are
    empty; repeated rows are turns of their own; null conv_id is a conversation like any other. The loss mask covers the
    texts of loss_role and nothing of the template. No turns, no conversations.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    said = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("inner"))
    said = said.withColumn("piece", F.concat("head", "inner", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = said.select(
        "conv_id", F.row_number().over(order).alias("at"), "piece",
        F.when(F.col("role") == loss_role, (before + F.length("head")).cast("int")).alias("start"), F.length("inner").alias("length"),
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "start", "length"))).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["start"].isNotNull()), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.col("parts.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, read back from what format_chats made."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.substr(head, F.lit(len(START) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(piece, F.length(head) + F.lit(2))).alias("text"))

    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + F.lit(1), s["length"])))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_chats over all conversations and one more, read back; nulls, ties and odd rows as stated there."""
    turns = canonical_turns(table(spark, sf_dir, "conversations"))
    probe = END + START + "assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    back = parse_chats(format_chats(turns.unionByName(extra)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
