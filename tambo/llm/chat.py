"""Chat formatting: turn rows -> one templated text per conversation, with its loss mask.

Turns are collected as structs, sorted, cut into runs of one role (adjacent
turns of a role become one block) and concatenated, all in Spark expressions.

Template, one block per run of turns::

    <|im_start|>ROLE<|im_sep|>TEXT<|im_cont|>TEXT<|im_end|>\\n

Inside roles and texts a backslash becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so a
control string can only come from the template and unescaping is exact.

Defined results: null text or role counts as empty; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order and
are all kept; a null conversation id is a conversation of its own; an empty
table gives no rows; only the four named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, CONT, END = "<|im_start|>", "<|im_sep|>", "<|im_cont|>", "<|im_end|>"
CLOSE = END + "\n"
#: Roles whose texts the loss is taken over.
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _blocks(turns: Column) -> Column:
    """Sorted turns -> array of (role, texts), one element per run of equal roles."""
    at = lambda i: F.get(turns, i)                                                  # noqa: E731
    every = F.sequence(F.lit(0), F.size(turns) - 1)
    heads = F.filter(every, lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))

    def block(head, k):
        stop = F.coalesce(F.get(heads, k + 1), F.size(turns))
        return F.struct(at(head)["role"].alias("role"),
                        F.transform(F.slice(turns, head + 1, stop - head), lambda t: t["text"]).alias("texts"))

    return F.transform(heads, block)


def _spans(blocks: Column) -> Column:
    """Loss spans (start, length in code points of the formatted text), in order."""
    none = F.array().cast("array<struct<start:int,length:int>>")

    def text_step(loss: Column):
        def step(acc, text):
            size = F.char_length(text)
            more = F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), size.alias("length"))))
            return F.struct((acc["at"] + size + len(CONT)).alias("at"), F.when(loss, more).otherwise(acc["spans"]).alias("spans"))
        return step

    def block_step(acc, b):
        begin = F.struct((acc["at"] + len(START) + F.char_length(b["role"]) + len(SEP)).alias("at"), acc["spans"].alias("spans"))
        return F.aggregate(b["texts"], begin, text_step(b["role"].isin(*LOSS_ROLES)),
                           lambda a: F.struct((a["at"] - len(CONT) + len(CLOSE)).alias("at"), a["spans"].alias("spans")))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("spans")), block_step, lambda a: a["spans"])


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation."""
    clean = rows.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"))
    convs = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    blocks = convs.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    pieces = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP),
                                                      F.array_join(b["texts"], CONT), F.lit(CLOSE)))
    return blocks.select("conv_id", F.array_join(pieces, "").alias("formatted"), _spans(F.col("blocks")).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Formatted text -> array of (role, text), one element per turn, unescaped."""
    blocks = F.slice(F.split(formatted, re.escape(CLOSE)), F.lit(1), F.size(F.split(formatted, re.escape(CLOSE))) - 1)

    def turns(block):
        role = unescape(F.substr(F.substring_index(block, SEP, 1), F.lit(len(START) + 1)))
        body = F.substr(block, F.length(F.substring_index(block, SEP, 1)) + len(SEP) + 1)
        return F.transform(F.split(body, re.escape(CONT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the mask, spans in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
