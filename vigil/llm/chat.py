"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all preceding turns are
context, and only that reply is trainable.  A conversation whose last turn is
no assistant turn (or that has none) gets one closing example more, with all
its turns as context and nothing trainable, so that no turn is lost.

Template, for each turn::

    <|turn|>ROLE
    TEXT<|/turn|>

Control strings start with ``<|``.  Inside texts and roles each ``<|`` is
written ``<||``, which no control string starts with, and a line break inside
a role is written ``<|n|>``; both are undone exactly when reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "<|turn|>"
END = "<|/turn|>\n"


def escape_text(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape_text(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(c, F.lit("<|n|>"), F.lit("\n")))


def prefix_target_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                           role: str = "role", text: str = "text",
                           assistant: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), target_turn (null for a
    closing example), formatted, loss_start and loss_chars (code points, the
    trainable span of ``formatted``), is_last.

    Null texts and roles count as empty.  Turns are ordered by turn number,
    nulls first; ties by role, then text; repeated rows stay repeated turns.
    Rows without conv_id form one conversation, as in GROUP BY.  Extra columns
    are ignored.  An empty table gives no example.

    The rendered conversation is built once and each example is a prefix of
    it, taken while the rows stream out; so a task holds one conversation, not
    all its prefixes.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    reply = escape_text(F.col("text"))
    t = (t.withColumn("head", head).withColumn("reply", reply)
         .withColumn("piece", F.concat("head", "reply", F.lit(END)))
         .withColumn("pos", F.row_number().over(in_order))
         .withColumn("until", F.sum(F.length("piece").cast("long")).over(
             in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "piece", "turn", (F.col("role") == assistant).alias("target"),
        (F.col("until") - F.length("reply") - len(END)).alias("loss_start"),
        F.length("reply").cast("long").alias("loss_chars"), "until"))).alias("parts"))
    last = F.element_at("parts", -1)
    slim = F.transform("parts", lambda p: F.struct(
        p["turn"].alias("target_turn"), p["target"].alias("target"),
        p["loss_start"].alias("loss_start"), p["loss_chars"].alias("loss_chars"),
        p["until"].alias("until")))
    # the last turn always ends an example: its own, or the closing one
    chosen = F.filter(slim, lambda p: p["target"] | (p["until"] == last["until"]))
    out = whole.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("whole"),
        last["until"].alias("total"), F.posexplode(chosen).alias("example", "x"))
    on = F.col("x.target")
    return out.select(
        "conv_id", "example", F.when(on, F.col("x.target_turn")).alias("target_turn"),
        F.substring("whole", F.lit(1), F.col("x.until").cast("int")).alias("formatted"),
        F.when(on, F.col("x.loss_start")).otherwise(F.col("x.until")).alias("loss_start"),
        F.when(on, F.col("x.loss_chars")).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
        (F.col("x.until") == F.col("total")).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        rest = F.substring(p, F.length(role) + 2, F.length(p))
        return F.struct(unescape_role(role).alias("role"), unescape_text(
            F.substring(rest, F.lit(1), F.length(rest) - len(END))).alias("text"))
    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The text under the loss mask of an example, unescaped."""
    return unescape_text(F.substring(formatted, loss_start.cast("int") + 1,
                                     loss_chars.cast("int")))


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the formatted examples of each conversation hold, read back from
    them: n_turns and turns_sha256 from the longest example, loss_chars and
    loss_sha256 over all masked texts in order, formatted_chars (length of all
    its examples together), n_examples.
    """
    e = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("is_last"), F.col("formatted")).alias("full"))
    g = e.groupBy("conv_id").agg(
        F.max("full").alias("full"), F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("parts"))
    g = g.withColumn("turns", read_turns(F.col("full"))).withColumn(
        "loss", F.array_join(F.transform("parts", lambda p: p["loss"]), ""))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
