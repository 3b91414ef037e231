"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template. A text or role never holds `#`, `<` or a lone backslash after `escape`.
HEAD, COLON, END = "### ", ": ", " </turn>\n"


def escape(c: Column) -> Column:
    """Backslash, `#` and `<` become `\\b`, `\\h` and `\\l`, so no control string can come from a text."""
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    """Undo `escape`. Each backslash of an escaped text begins a pair, so the backslash's own pair goes last."""
    for a, b in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def escape_role(c: Column) -> Column:
    """As `escape`; a colon becomes `\\c` too, since it ends the role."""
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\c"), F.lit(":")))


def with_segments(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq (from 0), role, segment, segment_start, loss_start, loss_len; lengths in code points.

    Turns go by (turn, role, text), nulls first, so ties and repeated rows have a fixed order and all stay.
    Null text and null role are empty. Rows of a null conv_id form one conversation of their own.
    Only those four columns are read; any others may have any name.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(COLON))
    rows = rows.select("conv_id", "turn", "role", "text", F.length(head).alias("head_len"), F.length(escape(F.col("text"))).alias("body_len"), F.concat(head, escape(F.col("text")), F.lit(END)).alias("segment"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum(F.length("segment")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select(
        "conv_id",
        (F.row_number().over(w) - 1).alias("seq"),
        "role",
        "segment",
        before.alias("segment_start"),
        (before + F.col("head_len")).alias("loss_start"),
        F.col("body_len").cast("long").alias("loss_len"),
    )


def format_chat(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted string, examples array<struct<seq, context_end, loss_start, loss_len>>.

    `formatted` holds the whole conversation once. Every turn of the role `assistant` is an example: its context is
    `formatted` up to context_end (all turns before it and its own head), and of it only the loss_len code points
    from loss_start on are trained. The prefix is held by reference, as written out it grows with the square of the turns.
    """
    t = with_segments(conversations)
    turn = F.struct("seq", "segment", (F.col("role") == assistant).alias("trained"), "loss_start", "loss_len")
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    example = lambda x: F.struct(x.seq.alias("seq"), x.loss_start.alias("context_end"), x.loss_start.alias("loss_start"), x.loss_len.alias("loss_len"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x.segment), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x.trained), example).alias("examples"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn of `format_chat`'s rows: conv_id, example (from 0), context_end, target (escaped, nothing but the reply).

    Its context is the first context_end code points of the conversation's `formatted`; it is held by reference.
    """
    x = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    return x.select("conv_id", "example", F.col("e.context_end").alias("context_end"), _target(F.col("e")).alias("target"))


def _target(e: Column) -> Column:
    return F.substr(F.col("formatted"), (e.loss_start + 1).cast("int"), e.loss_len.cast("int"))


def chat_examples(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """`expand` with every prefix written out: conv_id, example, context, target."""
    x = format_chat(conversations, assistant).select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    return x.select("conv_id", "example", F.expr("substring(formatted, 1, int(e.context_end))").alias("context"), _target(F.col("e")).alias("target"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a string of `format_chat`, unescaped."""
    parts = F.split(formatted, END.replace("/", "\\/"), -1)
    body = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.substr(s, F.lit(len(HEAD) + 1)))
    at = lambda s: F.instr(s, COLON)
    return F.transform(body, lambda s: F.struct(unescape_role(F.substr(s, F.lit(1), at(s) - 1)).alias("role"), unescape(F.substr(s, at(s) + len(COLON))).alias("text")))


def chat_digest(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Counts and digests of each conversation: its turns as read back from `formatted`, its loss text from the expanded examples.

    Every conversation is expanded to a row per assistant turn, which carries its reply and the counts of the conversation, not the text before it;
    one without such turns keeps one row without a reply.
    """
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    f = format_chat(conversations, assistant)
    f = f.select("conv_id", "formatted", "examples", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    x = f.select("conv_id", "n_turns", "turns_sha256", "formatted_chars", "formatted", F.posexplode_outer("examples").alias("example", "e"))
    x = x.select("conv_id", "n_turns", "turns_sha256", "formatted_chars", "example", unescape(_target(F.col("e"))).alias("reply"))
    replies = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "reply"))))
    g = x.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")], F.array_join(F.transform(replies, lambda r: r.reply), "").alias("loss"))
    return g.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
