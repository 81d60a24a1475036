"""Chat formatting with prefix-target expansion, in Spark SQL alone.

Every assistant turn becomes an example of its own: all turns before it as
context, then the turn, of which only the text is trainable. What follows the
last assistant turn makes one more example without a target, so that no turn is
lost. A turn is written

    <|im_start|>role\\ntext<|im_end|>\\n

with control strings inside roles and texts broken up by a backslash and every
backslash doubled, which one replacement undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What marks turns in this template and in other common ones; a backslash goes in after the first character.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    """Null becomes empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, text, loss_start, loss_end.

    The loss mask is the code points from loss_start (from 0) up to loss_end, both
    null in an example without a target. Null roles and texts are empty. Turns of
    one number go by role, then text; repeated rows are repeated turns; a null
    conversation id is an id like any other; other columns are ignored. A
    conversation has to fit in a task, as its examples do.
    """
    role = F.regexp_replace(escaped(F.col(role_col)), "\n", "\\\\\n")
    one = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), escaped(F.col(text_col)).alias("body"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
    )
    convs = turns.select(F.col(conv_col).alias("_id"), one.alias("t")).groupBy("_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    last = F.expr("filter(sequence(0, size(turns) - 1), i -> turns[i].role = 'assistant' or i = size(turns) - 1)")
    examples = convs.select("_id", "turns", F.posexplode(last).alias("example", "at"))
    before = F.concat_ws("", F.transform(F.slice("turns", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    step = examples.select("_id", "example", (F.col("at") + 1).cast("long").alias("n_turns"), before.alias("context"), F.col("turns")[F.col("at")].alias("t"))
    target = F.col("t.role") == "assistant"
    begin = F.length("context") + F.length("t.head")
    return step.select(
        F.col("_id").alias(conv_col), "example", "n_turns", F.concat("context", "t.head", "t.body", F.lit(END)).alias("text"),
        F.when(target, begin.cast("long")).alias("loss_start"), F.when(target, (begin + F.length("t.body")).cast("long")).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) out of a formatted example."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")
    head = r"^<\|im_start\|>((?s:\\.|[^\\\n])*)\n"
    return F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_replace(p, head, "")).alias("text")))


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, out of ``format_examples``' rows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The longest example holds all turns. formatted_chars sums over all examples.
    """
    loss = F.when(F.col("loss_start").isNotNull(), unescaped(F.expr("substr(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")))
    said = F.concat_ws("", F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    slim = examples.select(F.col(conv_col).alias("_id"), "example", "n_turns", "text", loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    per = slim.groupBy("_id").agg(
        F.max("n_turns").alias("n_turns"), F.max_by("text", "n_turns").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"), F.sum("chars").alias("formatted_chars"),
    )
    whole = F.concat_ws("", F.col("losses.loss"))
    return per.select(
        F.col("_id").alias(conv_col), F.size(read_turns(F.col("text"))).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(whole).cast("long").alias("loss_chars"), F.sha2(whole, 256).alias("loss_sha256"), "formatted_chars",
    )
