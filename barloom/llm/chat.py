"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all preceding turns as context and one reply, which alone is trainable. Turns are
marked by control strings; inside texts and roles every ``<`` and ``[`` is followed by a backslash, and
backslashes are doubled, so no text can hold a control string of this or another bracketed template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def _read_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def prefix_examples(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """``(conv_id, alone, example, prompt, reply)`` from ``conversations(conv_id, turn, role, text)``.

    One row for each turn whose role is ``trainable``: prompt is the context with the header of the
    reply, reply the escaped text with its end mark; the loss covers the reply's text. Turns after the
    last such turn make one more row with an empty reply, so that no turn is lost. Turns are ordered by
    turn, then role and text; a null turn comes first, null role and text count as empty. A row without
    conv_id is a conversation of its own, told from others by ``alone``, which is null for all other rows. Other
    columns are not read; an empty table stays empty.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    chats = conversations.select("conv_id", alone, row.alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    header = lambda t: F.concat(F.lit(BEGIN), _role(t["role"]), F.lit("\n"))
    chats = chats.select(
        "conv_id", "alone",
        F.transform("turns", header).alias("heads"),
        F.transform("turns", lambda t: F.concat(escape(t["text"]), F.lit(END))).alias("bodies"),
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == trainable) | (i == F.size("turns"))).alias("ends"),
        F.transform("turns", lambda t: t["role"]).alias("roles"),
    )
    marked = chats.select("*", F.arrays_zip("heads", "bodies").alias("parts"), F.posexplode("ends").alias("example", "end"))
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("end") - 1), lambda p: F.concat(p["heads"], p["bodies"])), "")
    head, body = F.element_at("heads", F.col("end")), F.element_at("bodies", F.col("end"))
    learns = F.element_at("roles", F.col("end")) == trainable
    prompt = F.concat(before, head, F.when(learns, F.lit("")).otherwise(body))
    return marked.select("conv_id", "alone", "example", prompt.alias("prompt"), F.when(learns, body).otherwise(F.lit("")).alias("reply"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds: array of struct(role, text)."""
    parts = F.filter(F.split(formatted, "\\Q" + END + "\\E", -1), lambda p: p.startswith(BEGIN))
    inner = lambda p: F.substr(p, F.lit(len(BEGIN) + 1))
    role = lambda p: F.substring_index(inner(p), "\n", 1)
    text = lambda p: F.substr(inner(p), F.length(role(p)) + 2)
    return F.transform(parts, lambda p: F.struct(_read_role(role(p)).alias("role"), unescape(text(p)).alias("text")))


def read_loss(reply: Column) -> Column:
    """The text under the loss mask of an example, unescaped."""
    return F.when(reply == "", F.lit("")).otherwise(unescape(F.substr(reply, F.lit(1), F.length(reply) - len(END))))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their texts."""
    last = F.max(F.struct("example", F.concat("prompt", "reply").alias("whole")))["whole"]
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", read_loss(F.col("reply")).alias("loss")))), lambda x: x["loss"]), "")
    chars = F.sum(F.length("prompt") + F.length("reply"))
    rows = examples.groupBy("conv_id", "alone").agg(last.alias("whole"), loss.alias("loss"), chars.alias("formatted_chars"))
    rows = rows.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
