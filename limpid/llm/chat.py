"""Chat formatting: conversations through a compiled template, with the spans a model is to learn, and back again.

Rows are sorted by conversation and turn in Spark and rendered as a stream, a message at a time, so a conversation
need not fit in memory: the text is cut, between messages, into pieces of about PIECE characters.  A conversation
with a large share of all rows is ranked by a range exchange and rendered block by block in many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.text import quote
from limpid.llm.common import hot_groups, python_stages, ranked, stage
from limpid.llm.templates import Controls, Output, Template, TemplateError

#: Characters of a piece, about; most conversations are one piece.
PIECE = 4 << 20


@dataclass(frozen=True)
class ChatFormat:
    """A template over `messages` (each with role and text), its control strings, and the pattern of one turn.

    The pattern reads back what the template writes: a turn's text is in the group named like its role, or in the
    group `other` with the role in the group `role`; both are escaped."""

    template: str
    controls: tuple[str, ...]
    turn: str


#: Users, assistants and system rows have marks of their own; any other role is written out.
INSTRUCT = ChatFormat(
    template="""
{%- for m in messages -%}
  {%- if m.role == 'user' -%}
    {{ '[INST] ' + (m.text | escape) + ' [/INST]' }}
  {%- elif m.role == 'assistant' -%}
    {{ '<s>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
  {%- elif m.role == 'system' -%}
    {{ '<<SYS>>' + '\\n' }}{{ m.text | escape }}{{ '\\n' + '<</SYS>>' }}
  {%- else -%}
    {{ '<<ROLE>>' }}{{ m.role | escape }}{{ '<</ROLE>>' }}{{ m.text | escape }}{{ '<</TURN>>' }}
  {%- endif -%}
{%- endfor -%}
""",
    controls=("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>"),
    turn=r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>"
         r"|<<ROLE>>(?P<role>.*?)<</ROLE>>(?P<other>.*?)<</TURN>>",
)


def render(chat: ChatFormat, messages: list[tuple[str, str]]) -> Output:
    """One conversation in memory: its text and the spans to learn."""
    return Template(chat.template, Controls(chat.controls)).render(messages=[{"role": r, "text": t} for r, t in messages])


def read_turns(chat: ChatFormat, text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    controls, pattern = Controls(chat.controls), re.compile(chat.turn, re.S)
    turns, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        found = {k: controls.unescape(v) for k, v in m.groupdict().items() if v is not None}
        turns.append((found["role"], found["other"]) if "other" in found else next(iter(found.items())))
        at = m.end()
    return turns


def _piece_type(id_type: T.DataType) -> T.StructType:
    span = T.StructType().add("start", "integer").add("stop", "integer")
    return (T.StructType().add("id", id_type).add("block", "long").add("piece", "integer").add("first", "long").add("turns", "long").add("n", "long")
            .add("formatted", "string").add("loss", T.ArrayType(span)))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def format_conversations(df: DataFrame, chat: ChatFormat = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", piece_chars: int = PIECE) -> DataFrame:
    """One row per conversation: id, block, piece, first, turns, n, formatted, loss.

    Messages are ordered by turn (null first), those with equal turns by role and text; repeated rows are messages
    each.  Null roles and texts are empty ones; rows without an id are one conversation.  loss holds the spans
    (start, stop) of code points of `formatted` that the template marks for learning.  A conversation whose text is
    longer than `piece_chars` is several rows, in the order of (block, piece), each of which begins at its message
    `first` and holds `turns` of all `n`; control strings and spans never cross from one into the next.  An empty
    table gives no rows.  Other columns, whatever their names, are ignored."""
    spark = df.sparkSession
    Template(chat.template, Controls(chat.controls)).by_message()  # a wrong template fails here, not in a task
    python_stages(spark)
    order = ["turn", "role", "text"]
    rows = df.select(quote(id_col).alias("id"), quote(turn_col).alias("turn"),
                     *[F.coalesce(quote(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    key = F.xxhash64("id").alias("key")
    hot, limit = hot_groups(rows.select(key), rows.count(), smallest=100_000)
    is_hot = key.isin(list(hot)) if hot else F.lit(False)
    columns = ["id", "block", "idx", "n", "role", "text"]
    own = Window.partitionBy("id")
    usual = rows.where(~is_hot).withColumns({"idx": (F.row_number().over(own.orderBy(*order)) - 1).cast("long"), "n": F.count(F.lit(1)).over(own), "block": F.lit(0).cast("long")})
    parts = [usual.select(columns)]
    if hot:
        cut = ranked(rows.where(is_hot), "id", order).withColumn("block", F.floor(F.col("idx") / limit))
        parts.append(cut.select(columns).repartition("id", "block").sortWithinPartitions("id", "block", "idx"))
    kind = _piece_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        messages = Template(chat.template, Controls(chat.controls)).by_message()
        schema = done = held = None
        out, at, piece, first, n = Output(), None, 0, 0, 0

        def row(upto: int) -> tuple:
            return (*at, piece, first, upto - first, n, out.text, [{"start": a, "stop": b} for a, b in out.spans])

        done, held, index = [], 0, -1
        for batch in batches:
            if schema is None:
                schema = pa.schema([("id", batch.schema.field("id").type), ("block", pa.int64()), ("piece", pa.int32()), ("first", pa.int64()), ("turns", pa.int64()),
                                    ("n", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
            for id_, block, idx, length, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (id_, block) != at or out.size >= piece_chars:
                    if at is not None and index + 1 > first:
                        done.append(row(index + 1))
                        held += out.size
                    piece = piece + 1 if (id_, block) == at else 0
                    at, first, out = (id_, block), idx, Output()
                    if held >= piece_chars:
                        yield _arrow(done, schema)
                        done, held = [], 0
                n, index = length, idx
                messages.write({"role": role, "text": text}, idx, length, out)
        if at is not None:
            yield _arrow([*done, row(index + 1)], schema)

    return parts[0].mapInArrow(run, kind) if len(parts) == 1 else parts[0].mapInArrow(run, kind).unionByName(parts[1].mapInArrow(run, kind))


def digests(formatted: DataFrame, chat: ChatFormat = INSTRUCT) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from the
    formatted text: its turns by the format's pattern, what is to be learned by the spans.

    `formatted` is read twice and should be a written table.  A digest runs over a conversation from its start to its
    end, so one that is in several pieces is read by one task, a piece at a time; all others stay where they are."""
    python_stages(formatted.sparkSession)
    kind = T.StructType([formatted.schema["id"], *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")])
    columns = ["id", "turns", "n", "formatted", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        controls = Controls(chat.controls)
        seen = learned = formatted_chars = 0
        turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows = []
            for id_, count, n, text, loss in zip(*[c.to_pylist() for c in batch.columns]):
                turns = read_turns(chat, text)
                if len(turns) != count:
                    raise ValueError(f"conversation {id_}: {count} turns were written and {len(turns)} read")
                turns_sha.update("".join([f"{role}\n{said}\n" for role, said in turns]).encode())
                learn = "".join([controls.unescape(text[s["start"] : s["stop"]]) for s in loss])
                loss_sha.update(learn.encode())
                seen, learned, formatted_chars = seen + len(turns), learned + len(learn), formatted_chars + len(text)
                if seen == n:
                    rows.append((id_, seen, turns_sha.hexdigest(), learned, loss_sha.hexdigest(), formatted_chars))
                    seen = learned = formatted_chars = 0
                    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
            if rows:
                yield _arrow(rows, pa.schema([("id", batch.schema.field("id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                              ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
        if seen:
            raise ValueError("a conversation lacks pieces")

    whole = F.col("turns") == F.col("n")
    pieces = formatted.where(~whole).repartition("id").sortWithinPartitions("id", "block", "piece")
    return formatted.where(whole).select(columns).mapInArrow(run, kind).unionByName(pieces.select(columns).mapInArrow(run, kind))


def formatted_table(df: DataFrame, chat: ChatFormat = INSTRUCT, **columns) -> DataFrame:
    """format_conversations, written to the shared folder and read back."""
    return stage(format_conversations(df, chat, **columns), "formatted-chats")
