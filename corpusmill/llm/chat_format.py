"""Chat formatting: turns become one text per conversation with marks, a loss mask and a way back.

Turn structs are collected and sorted; adjacent turns of one role share one mark and are told apart by an
inner mark, so merging loses nothing. Everything is array and string expressions whose cost is linear in a
conversation; a conversation is one text by definition, so it is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import bind

#: Fixed marks of the template. In texts, a backslash becomes \e, and the "<" of a mark becomes \l.
OPEN, CLOSE, INNER = "<turn:", "</turn>\n", "<part/>"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\e")), "<(?=turn:|/turn>|part/>)", "\\\\l")


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def _escape_role(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\e")), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")), F.lit("\\e"), F.lit("\\"))


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask: one row per conversation.

    Needs conv_id, turn, role, text; other columns are ignored. ``mask`` is a list of (length, loss): code point runs that
    cover ``formatted`` exactly, loss being the texts of role ``learn_from``. Turns are sorted by (turn, role, text),
    nulls first, so repeated turn numbers have one order and repeated rows stay. Null roles and texts are empty;
    rows without conv_id form one conversation.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(turns: Column, x: Column, i: Column) -> Column:
        before = F.get(turns, i - 1)["role"]
        header = F.when(i == 0, F.lit("")).when(before == x["role"], F.lit(INNER)).otherwise(F.lit(CLOSE))
        header = F.when((i > 0) & (before == x["role"]), header).otherwise(F.concat(header, F.lit(OPEN), _escape_role(x["role"]), F.lit(">\n")))
        return F.struct(header.alias("header"), escape(x["text"]).alias("text"), (x["role"] == learn_from).alias("loss"))

    pieces = held.select("conv_id", bind(F.col("turns"), lambda turns: F.transform(turns, lambda x, i: piece(turns, x, i))).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["header"], p["text"])), ""), F.lit(CLOSE))
    run = lambda text, loss: F.struct(F.length(text).cast("long").alias("length"), loss.alias("loss"))
    runs = F.flatten(F.transform("pieces", lambda p: F.array(run(p["header"], F.lit(False)), run(p["text"], p["loss"]))))
    return pieces.select("conv_id", formatted.alias("formatted"), F.concat(runs, F.array(run(F.lit(CLOSE), F.lit(False)))).alias("mask"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, length, loss): what a formatted text and its mask say.

    Every second run of a mask is a text; its length must be that of the text found between the marks, else loss is null.
    """
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")
    body = lambda b: F.split(F.substring(b, F.locate(">\n", b) + 2, F.length(b)), INNER)
    role = lambda b: _unescape_role(F.substring(b, F.lit(len(OPEN) + 1), F.locate(">\n", b) - len(OPEN) - 1))
    blocks = F.transform(blocks, lambda b: F.transform(body(b), lambda t: F.struct(role(b).alias("role"), t.alias("raw"))))
    found = chats.select("conv_id", "formatted", "mask", F.flatten(blocks).alias("found"))

    def turn(mask: Column, x: Column, i: Column) -> Column:
        run = F.get(mask, 2 * i + 1)
        return F.struct(x["role"].alias("role"), unescape(x["raw"]).alias("text"), F.when(run["length"] == F.length(x["raw"]), run["loss"]).alias("loss"))

    return found.select("conv_id", "formatted", bind(F.col("mask"), lambda mask: F.transform("found", lambda x, i: turn(mask, x, i))).alias("turns"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    back = parse_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
