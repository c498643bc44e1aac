"""Chat formatting with a grammar that reads back exactly.

Grammar of a formatted conversation::

    conversation = { turn }
    turn         = "[INST] " role " [/INST]\n" text "\n</s>\n"

The strings of ``CONTROL`` are markup unless a backslash stands before them.  Reading back
removes one backslash in front of each escaped control string.  A conversation is rendered
as it is, reparsed and compared with its source; if the turns differ, its conflicting
content (control strings, with the backslashes before them) gets one more backslash and the
result is reparsed again.  ``round_trip`` says whether the last reading was identical.

Everything is a DataFrame expression.  One conversation is one row, as its output is one
string; conversations are spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template and of formats it is mixed with.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

HEAD, MIDDLE, TAIL = "[INST] ", " [/INST]\n", "\n</s>\n"
ANY = r"(?:</?s>|\[/?INST\]|<</?SYS>>)"
# A control string with no backslash before it, between the line ends that turns have.
END = r"\n(?<!\\)</s>\n"
PARTED = r" (?<!\\)\[/INST\]\n"
OPENS = r"^\[INST\] "
STRAY = rf"(?<!\\){ANY}"

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{ANY})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{ANY})", "$1")


def render(turns: Column) -> Column:
    """The formatted string of turns whose texts are escaped already."""
    return F.concat_ws(
        "",
        F.transform(
            turns,
            lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(TAIL)),
        ),
    )


def spans(formatted: Column) -> Column:
    """Turns as they stand in the string: role and text still escaped, text's place.

    Splits at turn ends, then at the first head end.  Places count code points from 0.
    """
    parts = F.split(formatted, END)
    # What follows the last turn end must be empty, else it is kept as a broken turn.
    bodies = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    def step(acc: Column, part: Column) -> Column:
        halves = F.split(part, PARTED, 2)
        role = F.regexp_replace(halves[0], OPENS, "")
        text = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        start = acc["at"] + F.length(halves[0]) + len(MIDDLE)
        turn = F.struct(
            role.alias("role"),
            text.alias("text"),
            start.cast("long").alias("start"),
            F.length(text).cast("long").alias("length"),
            (part.rlike(OPENS) & (F.size(halves) == 2) & ~role.rlike(STRAY) & ~text.rlike(STRAY)).alias("sound"),
        )
        at = acc["at"] + F.length(part) + len(TAIL)
        return F.struct(at.cast("long").alias("at"), F.concat(acc["turns"], F.array(turn)).alias("turns"))

    empty = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<role:string,text:string,start:bigint,length:bigint,sound:boolean>>").alias("turns"),
    )
    return F.aggregate(bodies, empty, step)["turns"]


def read_back(found: Column) -> Column:
    """Recovered turns; a turn that breaks the grammar is null."""
    return F.transform(
        found,
        lambda t: F.when(
            t["sound"], F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
        ),
    )


def format_conversations(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: str = "assistant",
) -> DataFrame:
    """One formatted string per conversation.

    Columns: conv_id, formatted, turns (read back from it), loss_spans (start and length of
    the texts with role ``learned``, in code points of ``formatted``), escaped, round_trip.
    Rows are ordered by turn, ties by role and text; repeated rows are turns of their own.
    Null roles and texts are empty, a null turn comes first, rows without a conversation
    form one; an empty table gives no rows.  Other columns are not read.
    """
    source = (
        rows.select(
            F.col(conv).alias("conv_id"),
            F.struct(
                F.col(turn).alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            ).alias("one"),
        )
        .groupBy("conv_id")
        .agg(F.transform(F.sort_array(F.collect_list("one")), lambda t: F.struct(t["role"], t["text"])).cast(TURNS).alias("source"))
    )
    plain = source.withColumn("plain", render(F.col("source"))).withColumn("found", spans(F.col("plain")))
    conflict = ~read_back(F.col("found")).eqNullSafe(F.col("source"))
    strict = F.transform("source", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    chosen = plain.withColumn("escaped", conflict).withColumn(
        "formatted", F.when(F.col("escaped"), render(strict)).otherwise(F.col("plain"))
    )
    again = chosen.withColumn(
        "found", F.when(F.col("escaped"), spans(F.col("formatted"))).otherwise(F.col("found"))
    ).withColumn("turns", read_back(F.col("found")))
    mine = F.filter("found", lambda t: unescape(t["role"]) == learned)
    return again.select(
        "conv_id",
        "formatted",
        "turns",
        F.transform(mine, lambda t: F.struct(t["start"], t["length"])).alias("loss_spans"),
        "escaped",
        F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"),
    )


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.concat_ws(
        "",
        F.transform(
            loss_spans,
            lambda s: unescape(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what reads back from formatted conversations."""
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trip",
    )
