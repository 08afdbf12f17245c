"""Relational chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged into one block, and blocks are concatenated:

    <|start|>role<|sep|>text<|next|>text<|end|>

``<|next|>`` keeps the boundary between merged turns, so formatting is
reversible.  Control strings inside texts and roles, those of this template and
those of other common templates alike, are broken by a backslash after their
first character, and backslashes are doubled; one left-to-right pass undoes it.

The loss mask is an array of half-open code point ranges of the formatted text:
each assistant text, without its markers.

Defined results: null text and null role count as empty; turns sort by number
(null first), then role, then text, so ties and repeated rows are stable; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerloom.llm.shared import let

START, SEP, NEXT, END = "<|start|>", "<|sep|>", "<|next|>", "<|end|>"
#: Strings with a meaning for a model, never to be forged by a text.
CONTROL = (START, SEP, NEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
#: Cells of one running sum; the sums of such groups are added up in turn.
_GROUP = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opens(turns: Column, i: Column) -> Column:
    """Whether the turn at ``i`` starts a block."""
    return (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"])


def _merge(turns: Column) -> Column:
    """Adjacent turns of one role as one block with their texts in order; each turn is copied once."""
    firsts = F.filter(F.transform(turns, lambda _, i: i), lambda i: _opens(turns, i))

    def blocks(at: Column) -> Column:
        run = lambda first, j: F.slice(turns, first + 1, F.coalesce(F.get(at, j + 1), F.size(turns)) - first)
        return F.transform(at, lambda first, j: F.struct(F.get(turns, first)["role"].alias("role"), F.transform(run(first, j), lambda t: t["text"]).alias("texts")))

    return let(firsts, blocks)


def _running(start: Column, widths: Column) -> Column:
    """``start`` plus the sum of all widths before each place."""
    grow = lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + w))
    every = F.aggregate(widths, F.array(start), grow)
    return F.slice(every, 1, F.size(widths))


def _places(widths: Column) -> Column:
    """Sum of all widths before each place, in groups, so that long lists are not copied for each element."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(widths) - 1), F.lit(_GROUP)), lambda at: F.slice(widths, at + 1, _GROUP))

    def summed(g: Column) -> Column:
        totals = F.transform(g, lambda x: F.aggregate(x, F.lit(0), lambda n, w: n + w))
        return let(_running(F.lit(0), totals), lambda starts: F.flatten(F.transform(g, lambda x, i: _running(F.get(starts, i), x))))

    return let(groups, summed)


def _spans(turns: Column) -> Column:
    """Ranges of assistant texts in the formatted text; turns hold escaped strings."""
    lead = lambda t, i: F.when(_opens(turns, i), F.length(t["role"]) + len(START) + len(SEP)).otherwise(0)
    tail = lambda i: F.when((i + 1 < F.size(turns)) & ~_opens(turns, i + 1), len(NEXT)).otherwise(len(END))
    widths = F.transform(turns, lambda t, i: lead(t, i) + F.length(t["text"]) + tail(i))

    def spans(at: Column) -> Column:
        span = lambda t, i: F.struct((F.get(at, i) + lead(t, i)).alias("start"), (F.get(at, i) + lead(t, i) + F.length(t["text"])).alias("stop"))
        return F.array_compact(F.transform(turns, lambda t, i: F.when(t["role"] == LOSS_ROLE, span(t, i))))

    return let(let(widths, _places), spans)


def format_conversations(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    safe = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))))
    block_text = lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], NEXT), F.lit(END))
    whole = lambda t: F.struct(F.array_join(F.transform(_merge(t), block_text), "").alias("formatted"), _spans(t).alias("loss_spans"))
    return safe.select("conv_id", let(F.col("turns"), whole).alias("x")).select("conv_id", "x.formatted", "x.loss_spans")


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read back: array of struct(role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring(F.substring_index(block, SEP, 1), len(START) + 1, 2**31 - 1))
        body = F.substr(block, F.length(F.substring_index(block, SEP, 1)) + F.lit(len(SEP) + 1))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"])))
