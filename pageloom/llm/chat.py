"""Chat formatting: typed content parts are flattened into one string per conversation, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Placeholder of each part type that is not text, and how many tokens one unit of it takes (an image's patches, an audio's frames, a document's pages).
PLACEHOLDERS = {"image": ("<|image|>", 1), "audio": ("<|audio|>", 1), "document": ("<|document|>", 256)}
#: Stands before a digit while parts are joined: 0 for this character itself in a text, 1 and more for the placeholders. It is not in the output unless a text has it.
HOLD = "\ue000"


def escape(text: Column) -> Column:
    """Puts one more backslash into every "<", backslashes, "|", so that no control string is left; unescape takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def visit(part: Column) -> Column:
    """(text, mark, ref, tokens) of one content part, struct<type, text, ref, units>: a text keeps its text, another known type becomes the sign of its placeholder, anything else is empty. mark, ref and tokens are null for text."""
    kind, units = part["type"], F.coalesce(part["units"], F.lit(1)).cast("long")
    text, mark, tokens = F.when(kind == "text", F.replace(F.coalesce(part["text"], F.lit("")), F.lit(HOLD), F.lit(HOLD + "0"))), F.lit(None).cast("string"), F.lit(None).cast("long")
    for i, (name, (sign, each)) in enumerate(PLACEHOLDERS.items(), 1):
        text, mark, tokens = text.when(kind == name, F.lit(f"{HOLD}{i}")), F.when(kind == name, sign).otherwise(mark), F.when(kind == name, units * each).otherwise(tokens)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), mark.alias("mark"), F.when(tokens.isNotNull(), part["ref"]).alias("ref"), tokens.alias("tokens"))


def flat(content: Column) -> Column:
    """The text of visited parts, in order. It is escaped as a whole, so that no control string arises where two texts meet; placeholders come in afterwards."""
    joined = escape(F.array_join(F.transform(content, lambda p: p["text"]), ""))
    for i, (sign, _) in enumerate(PLACEHOLDERS.values(), 1):
        joined = F.replace(joined, F.lit(f"{HOLD}{i}"), F.lit(sign))
    return F.replace(joined, F.lit(HOLD + "0"), F.lit(HOLD))


VISITED = "array<struct<text:string,mark:string,ref:string,tokens:long>>"


def text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text") -> DataFrame:
    """(conv, formatted, loss_spans, attachments, attachment_tokens), one row per conversation.

    rows are turns; parts is a column of content parts, by default one text part of text_col. A turn reads <|im_start|>role, newline, content, <|im_end|>, newline; turns go by turn_col, nulls first, ties by role and content. Null roles, texts, parts and arrays of parts count as empty; texts of neighbouring parts are read as one, so control strings spread over several parts are escaped too; rows with a null conversation id make one conversation; repeated rows are repeated turns; an empty table gives an empty one. loss_spans are the places (start, length, in characters from 0) of the assistant's content; attachments are the parts that are not text, in order, with their reference and expanded token count.
    """
    content = F.coalesce(F.transform(parts if parts is not None else text_part(F.col(text_col)), visit), F.array().cast(VISITED))
    role = F.replace(escape(F.coalesce(F.col(role_col), F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        flat(F.col("__content")).alias("text"),
        F.filter("__content", lambda p: p["tokens"].isNotNull()).alias("attached"),
    )
    turns = rows.select(F.col(conv_col), role.alias("__role"), F.col(turn_col), content.alias("__content"), F.col(role_col)).groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n")))
    ends = F.length(F.lit(END + "\n"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    spans = F.aggregate(
        F.arrays_zip(F.col("turns").alias("t"), heads.alias("h")),
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["h"]) + F.length(x["t"]["text"]) + ends).cast("long").alias("at"),
            F.when(
                x["t"]["role"] == "assistant",
                F.array_append(acc["spans"], F.struct((acc["at"] + F.length(x["h"])).cast("long").alias("start"), F.length(x["t"]["text"]).cast("long").alias("length"))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    attached = F.transform(F.flatten(F.transform("turns", lambda t: t["attached"])), lambda p: F.struct(p["mark"].alias("placeholder"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"])
    return turns.select(conv_col, formatted.alias("formatted"), spans.alias("loss_spans"), attached.alias("attachments")).withColumn("attachment_tokens", tokens)


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    body = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")
    return F.transform(
        body,
        lambda t: F.struct(
            unescape(F.replace(F.substring_index(t, "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(t, F.instr(t, F.lit("\n")) + 1, F.length(t) - F.instr(t, F.lit("\n")) - len(END) - 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what is read back from formatted conversations."""
    turns = chats.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
