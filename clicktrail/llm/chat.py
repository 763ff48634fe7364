"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and
texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (a line feed in a
role becomes ``&nl;``), so a marker can only come from the template and the
escaping can be undone. Every assistant turn becomes one example: the
conversation up to and including that turn, where the loss mask covers the
turn's text alone and all turns before it are context.

Examples share their context, so they are kept as spans of the conversation's
one rendering (``rendered``, ``targets``); ``examples`` cuts the formatted
texts out when they are needed, without another shuffle.

Defined cases: null texts and roles are empty; null turns come first; equal
turns are ordered by role, then text, and repeated rows stay repeated; a
conversation without assistant turns has no example; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, ("&", "&amp;"), ("<|", "&lt;|"))


def unescape(c: Column) -> Column:
    return _swap(c, ("&nl;", "\n"), ("&lt;|", "<|"), ("&amp;", "&"))


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, rendered, targets``: each conversation's text and the spans (code points) of its assistant turns.

    ``targets`` holds, per assistant turn in order, ``start`` and ``end`` of its
    text (the loss mask) and ``stop``, the end of the example.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(START), _swap(escape(F.col("role")), ("\n", "&nl;")), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = (
        clean.withColumn("head", head)
        .withColumn("piece", F.concat("head", escape(F.col("text")), F.lit(END)))
        .withColumn("no", F.row_number().over(order))
        .withColumn("stop", F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    span = F.struct(
        (F.col("stop") - F.char_length("piece") + F.char_length("head")).alias("start"),
        (F.col("stop") - len(END)).alias("end"),
        F.col("stop"),
    )
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece"))), lambda x: x["piece"]), "").alias("rendered"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("targets"),
    )


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn (one with nulls where there is none): ``example`` number, ``formatted`` text, ``mask_start``, ``mask_end``.

    All columns of ``rendered`` but the text itself stay, so that what was read
    from the whole conversation can be carried along.
    """
    keep = [c for c in rendered.columns if c not in ("rendered", "targets")]
    rows = rendered.select(*keep, "rendered", F.posexplode_outer("targets").alias("example", "target"))
    return rows.select(
        *keep,
        "example",
        F.expr("substring(rendered, 1, cast(target.stop as int))").alias("formatted"),
        F.col("target.start").alias("mask_start"),
        F.col("target.end").alias("mask_end"),
    )


def read_turns(rendered: Column) -> Column:
    """The turns, as ``array<struct<role, text>>``, read back from a formatted text."""
    parts = F.split(rendered, END_PATTERN, -1)
    body = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.substr(x, F.lit(len(START) + 1)))
    cut = F.transform(body, lambda x: F.struct(F.instr(x, "\n").alias("at"), x.alias("x")))
    return F.transform(
        cut,
        lambda x: F.struct(
            unescape(F.substr(x["x"], F.lit(1), x["at"] - 1)).alias("role"),
            unescape(F.substr(x["x"], x["at"] + 1)).alias("text"),
        ),
    )


def read_masked(formatted: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substr(formatted, start.cast("int") + 1, (end - start).cast("int")))


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted output says, per conversation: turns, text under the loss masks, characters of all examples."""
    turns = read_turns(F.col("rendered"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = rendered.withColumn("turns", turns).select(
        "conv_id", "rendered", "targets", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256")
    )
    loss = examples(read).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        "example",
        read_masked(F.col("formatted"), F.col("mask_start"), F.col("mask_end")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (
        loss.groupBy("conv_id", "n_turns", "turns_sha256")
        .agg(together.alias("loss"), F.coalesce(F.sum("chars"), F.lit(0)).alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
