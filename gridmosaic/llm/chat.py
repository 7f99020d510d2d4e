"""Conversations as training text with a loss mask, by relational formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Control strings of the template.
HEAD, COLON, NEXT, END = "### ", ": ", "<msg/>", "</turn>\n"


def escape(text: Column) -> Column:
    """Double each backslash, then part every control string by a single one: none is left, and `unescape` reverses it."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for found, put in (("##", "#\\#"), ("</turn>", "<\\/turn>"), ("<msg/>", "<\\msg/>")):
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def unescape(text: Column) -> Column:
    """Between doubled backslashes every backslash is one that `escape` put in."""
    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), lambda x: F.replace(x, F.lit("\\"), F.lit(""))), "\\")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    r"""One formatted text per conversation.

    `turns` has conv_id, turn, role, text. The turns of a conversation are collected as structs and sorted by turn, role and text
    (null first; repeated rows stay). Adjacent turns of one role become one block `### role: text</turn>\n`, in which `<msg/>`
    parts the messages. Control strings inside roles and texts are escaped reversibly. Each run of messages is cut out of the sorted array by
    its first and last index, so the work is linear in the length. A conversation is one output value, so its turns meet in one row.

    Null text and null role count as empty; a null conv_id is a conversation of its own. Other columns are dropped. Empty table: no rows.
    Returns conv_id, n_messages, n_blocks, formatted, segments: array of (piece, loss), whose pieces concatenated are the formatted text;
    loss marks the message texts of `loss_roles`.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text"))))
    convs = turns.groupBy("conv_id").agg(sorted_turns.alias("t"))
    convs = convs.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"])))
    convs = convs.withColumn("blocks", F.transform("starts", lambda s, k: F.struct(
        F.element_at("t", s)["role"].alias("role"),
        F.transform(F.slice("t", s, F.coalesce(F.get("starts", k + 1), F.size("t") + 1) - s), lambda m: m["text"]).alias("texts"))))

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("piece"), loss.alias("loss"))

    def pieces(block: Column) -> Column:
        role = F.replace(escape(block["role"]), F.lit(COLON), F.lit(":\\ "))
        head = segment(F.concat(F.lit(HEAD), role, F.lit(COLON)), F.lit(False))
        learn = block["role"].isin(*loss_roles)
        body = F.transform(block["texts"], lambda x, i: F.array(segment(F.when(i == 0, "").otherwise(NEXT), F.lit(False)), segment(escape(x), learn)))
        return F.concat(F.array(head), F.flatten(body), F.array(segment(F.lit(END), F.lit(False))))

    out = convs.withColumn("segments", F.filter(F.flatten(F.transform("blocks", pieces)), lambda s: F.length(s["piece"]) > 0))
    return out.select(
        "conv_id", F.size("t").cast("long").alias("n_messages"), F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """The messages (role, text) that a formatted text holds, read from the text alone."""
    blocks = F.filter(F.split(formatted, "</turn>\n", -1), lambda b: F.length(b) > 0)

    def messages(block: Column) -> Column:
        at = F.instr(block, COLON)
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), at - len(HEAD) - 1))
        body = F.substring(block, at + len(COLON), F.length(block))
        return F.transform(F.split(body, NEXT, -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, messages))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
