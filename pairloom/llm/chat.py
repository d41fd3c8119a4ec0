"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document.  A visitor goes
through them in order and flattens them to one string: text stays, anything else becomes
a placeholder, numbered over the conversation, whose attachment is recorded with the
number of tokens it expands to in the model's input.  Text and roles can't say a marker
or a placeholder: what would begin one is escaped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TOKENIZER, Encoder, slices, table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"
#: Image tiles of this many pixels a side and tokens of each, plus one overview tile.
TILE, TILE_TOKENS = 448, 256
AUDIO_TOKENS_A_SECOND, PAGE_TOKENS = 25, 1024
ROLE = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
END = "<|end|>"
_ATTACHED = [("n", T.IntegerType()), ("turn", T.LongType()), ("type", T.StringType()), ("ref", T.StringType()), ("tokens", T.LongType())]


def _tiles(side: int | None) -> int:
    return max(1, -(-max(side or 1, 1) // TILE))


def _seconds(x: float | None) -> float:
    return x if x is not None and 0 < x < float("inf") else 0.0


#: Tokens that the placeholder of each type of part expands to; unknown sizes count as the least.
VISIT: dict[str, Callable[[dict], int]] = {
    "image": lambda p: (_tiles(p["width"]) * _tiles(p["height"]) + 1) * TILE_TOKENS,
    "audio": lambda p: max(1, math.ceil(_seconds(p["seconds"]) * AUDIO_TOKENS_A_SECOND)),
    "document": lambda p: max(1, p["pages"] or 1) * PAGE_TOKENS,
}
_MARK = re.compile(r"(^|<)\|")


def escaped(text: str) -> str:
    """Text in which no marker can begin, and which completes none that the text before it began."""
    return _MARK.sub(r"\1\\|", text) if "|" in text else text


def opened(role: str | None) -> str:
    """The line that begins a message; roles that aren't known stand after ``role:``."""
    if role is None:
        return "<|unknown|>\n"
    return ROLE.get(role, f"<|role:{re.sub('[<|>]|[\r\n]', '_', role)}|>") + "\n"


def visited(messages: list[dict]) -> tuple[str, str, list[dict]]:
    """(prompt, prompt without placeholders, attachments) of the messages in order."""
    prompt: list[str] = []
    said: list[str] = []
    listed: list[dict] = []
    for m in messages:
        mark = opened(m["role"])
        prompt.append(mark)
        said.append(mark)
        for p in m["parts"] or ():
            if p is None:
                continue
            if p["type"] == "text":
                if p["text"]:
                    words = escaped(p["text"])
                    prompt.append(words)
                    said.append(words)
                continue
            kind = p["type"] if p["type"] in VISIT else "document"
            listed.append({"n": len(listed) + 1, "turn": m["turn"], "type": kind, "ref": p["ref"], "tokens": VISIT[kind](p)})
            prompt.append(f"<|{kind}_{len(listed)}|>")
        prompt.append(END + "\n")
        said.append(END + "\n")
    return "".join(prompt), "".join(said), listed


def text_parts(text: Column) -> Column:
    """One text part of a plain message; no part of a null one."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    return F.when(text.isNotNull(), F.array(part)).otherwise(F.expr(f"cast(array() as {PARTS})"))


def json_parts(content: Column) -> Column:
    """Parts of a message whose content is a JSON list of parts, else its plain text."""
    parsed = F.from_json(content, PARTS, {"mode": "PERMISSIVE"})
    listed = content.rlike(r"^\s*\[\s*\{") & parsed.isNotNull()
    return F.when(listed, parsed).otherwise(text_parts(content))


def formatted(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, prompt, attachments, n_messages, text_tokens, expanded_tokens) of every conversation.

    Messages go by turn, equal turns by role and content; a null turn comes first.  A
    message is its role's marker, a line break, its flattened parts and the end marker.
    Unknown roles are written as ``<|role:NAME|>``, null ones as ``<|unknown|>``.  Null and
    empty text parts and null parts add nothing; a part of an unknown type, a null one
    too, is a document.  In text, ``<|`` is written as ``<\\|``, and so is a ``|`` that a
    part begins with, so that nobody can write a marker or a placeholder.
    ``attachments`` lists (n, turn, type, ref, tokens) by placeholder ``<|type_n|>``;
    images count by tiles whatever their size, sizes that are null, not positive or not
    finite as the least.  ``text_tokens`` counts the prompt without placeholders, whole,
    and ``expanded_tokens`` adds what these expand to.  A conversation without any part
    has markers only.  Rows with a null conversation are left out; repeated rows are
    repeated messages.  Other columns are left out.  A prompt is one value, so one task
    holds a conversation, as long as it is.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(parts_col).cast(PARTS).alias("parts")).where("conv_id IS NOT NULL")
    one = F.struct("turn", "role", "parts")
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    kind = T.StructType([T.StructField("conv_id", messages.schema[conv_col].dataType), T.StructField("prompt", T.StringType()), T.StructField("attachments", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _ATTACHED]))), T.StructField("n_messages", T.IntegerType()), T.StructField("text_tokens", T.LongType()), T.StructField("expanded_tokens", T.LongType())])
    listing = pa.list_(pa.struct([("n", pa.int32()), ("turn", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for b in slices(batches):
            prompts, lists, counts, tokens, expanded = [], [], [], [], []
            for m in b.column(1).to_pylist():
                # array_sort puts null fields last; messages without a turn go first
                prompt, said, listed = visited([x for x in m if x["turn"] is None] + [x for x in m if x["turn"] is not None])
                prompts.append(prompt)
                lists.append(listed)
                counts.append(len(m))
                tokens.append(enc.length(said))
                expanded.append(tokens[-1] + sum(x["tokens"] for x in listed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prompts, pa.string()), pa.array(lists, listing), pa.array(counts, pa.int32()), pa.array(tokens, pa.int64()), pa.array(expanded, pa.int64())], names=kind.names)

    return convs.mapInArrow(run, kind)


def with_attachments(conversations: DataFrame) -> DataFrame:
    """The conversations table with typed parts: it holds text only, so attachments are added by a rule of the ids.

    A user's message ends in an image where conv_id + turn leaves 0 by 3, an audio clip
    where it leaves 1 by 5, and a document where it leaves 2 by 7; the image stands before the text.
    """
    key = F.col("conv_id") + F.col("turn")
    user = F.col("role") == "user"

    def part(kind: str, suffix: str, **size) -> Column:
        fields = {"type": F.lit(kind), "text": F.lit(None).cast("string"), "ref": F.concat(F.lit(f"{kind}/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(suffix)), "width": F.lit(None), "height": F.lit(None), "seconds": F.lit(None), "pages": F.lit(None)} | size
        kinds = {"width": "int", "height": "int", "seconds": "double", "pages": "int"}
        return F.struct(*(c.cast(kinds[n]).alias(n) if n in kinds else c.alias(n) for n, c in fields.items()))

    none = F.expr(f"cast(array() as {PARTS})")
    image = F.when(user & (key % 3 == 0), F.array(part("image", ".png", width=256 + key * 97 % 3000, height=256 + key * 61 % 2000))).otherwise(none)
    audio = F.when(user & (key % 5 == 1), F.array(part("audio", ".wav", seconds=1 + key % 240))).otherwise(none)
    paper = F.when(user & (key % 7 == 2), F.array(part("document", ".pdf", pages=1 + key % 40))).otherwise(none)
    return conversations.withColumn("parts", F.concat(image, text_parts(F.col("text")), audio, paper))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, with parts added by ``with_attachments``.

    Nulls, empty and long texts, ties, repeated rows, empty tables and further columns are
    as in ``formatted``.
    """
    return formatted(with_attachments(table(spark, sf_dir, "conversations")))
