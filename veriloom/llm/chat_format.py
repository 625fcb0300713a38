"""Chat formatting: turns of typed content parts are flattened by a visitor, marked by a template and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template of a turn: START role \n content END.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of an image tile (and pixels of its side), of a second of audio, of a document page.
TILE_TOKENS, TILE, SECOND_TOKENS, PAGE_TOKENS = 170, 512, 25, 600

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text) -> F.Column:
    """Backslashes are doubled and <| becomes <\\|, so that no text holds a control string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text) -> F.Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role) -> F.Column:
    """A role ends at a line break, so its own are written <\\/>."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/>"))


def unescape_role(role) -> F.Column:
    return unescape(F.replace(role, F.lit("<\\/>"), F.lit("\n")))


class PlaceholderVisitor:
    """What each type of part turns into: (text in place, tokens that it expands to, whether it refers to an attachment).

    A type without a method is written as its escaped text, like text itself.
    """

    def text(self, part):
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0), F.lit(False)

    def image(self, part):
        side = lambda x: F.ceil(F.coalesce(part[x], F.lit(1)) / TILE)
        return F.lit("<|image|>"), (side("width") * side("height") * TILE_TOKENS).cast("int"), F.lit(True)

    def audio(self, part):
        return F.lit("<|audio|>"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SECOND_TOKENS).cast("int"), F.lit(True)

    def document(self, part):
        return F.lit("<|document|>"), (F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS).cast("int"), F.lit(True)

    def visit(self, part) -> F.Column:
        found = self.text(part)
        for kind in ("image", "audio", "document"):
            own = getattr(self, kind)(part)
            found = [F.when(part["type"] == kind, a).otherwise(b) for a, b in zip(own, found)]
        return F.struct(found[0].alias("content"), found[1].alias("tokens"), found[2].alias("attached"), part["type"].alias("type"), part["ref"].alias("ref"))


def text_part(text) -> F.Column:
    """One part of type text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_chats(turns: DataFrame, visitor: PlaceholderVisitor | None = None) -> DataFrame:
    """One row a conversation (conv_id, n_turns, formatted, loss_starts, loss_ends, attachments, expanded_tokens) from rows (conv_id, turn, role, parts).

    parts is an array of PART. Turns go by turn, then role, then content. loss_starts and loss_ends are the code points of formatted between
    which the assistant's contents stand. attachments lists the references in order, each with its turn, type and expanded tokens.
    Null roles and parts count as empty; null conversation ids are one conversation; other columns are ignored.
    """
    visitor = visitor or PlaceholderVisitor()
    seen = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visitor.visit)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), seen.alias("seen"))
    content = F.array_join(F.transform("seen", lambda p: p["content"]), "")
    rows = rows.withColumn("content", content).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("line", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("line") + F.length("head"))
    attached = F.transform(F.filter("seen", lambda p: p["attached"]), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    one = F.struct("at", "line", (F.col("role") == "assistant").alias("loss"), "start", (F.col("start") + F.length("content")).alias("end"), attached.alias("attached"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    lost = F.filter("t", lambda x: x["loss"])
    attachments = F.flatten(F.transform("t", lambda x: x["attached"]))
    return held.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.transform(lost, lambda x: x["start"]).alias("loss_starts"), F.transform(lost, lambda x: x["end"]).alias("loss_ends"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def _under_mask(formatted: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return pa.array(["".join(t[a:b] for a, b in zip(i, j)) for t, i, j in zip(formatted.to_pylist(), starts.to_pylist(), ends.to_pylist())], pa.string())


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text) parsed from formatted, and loss_text, what stands under the loss mask; placeholders are read as they stand."""
    lines = F.split("formatted", "<\\|im_end\\|>\n")
    lines = F.slice(lines, 1, F.size(lines) - 1)

    def turn(line):
        cut = F.instr(line, F.lit("\n"))
        return F.struct(unescape_role(F.substring(line, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"), unescape(F.substring(line, cut + 1, F.length(line))).alias("text"))

    return chats.withColumns({"turns": F.transform(lines, turn), "loss_text": unescape(F.arrow_udf(_under_mask, "string")("formatted", "loss_starts", "loss_ends"))})
