"""Chat formatting with a grammar round trip.

A turn is ``<s>[INST] role [/INST]text</s>``; a conversation is its turns end to
end. A turn that holds a control string is escaped and its header says so
(``[INST+]``), so control strings stand only where the template puts them. Rendered text is parsed
again: turns end at ``</s>``, the header at the first ``[/INST]``. Where the parse does not give back
the source, all turns are escaped. Escaped text holds no
``<`` or ``[``, so that form always parses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed strings of the grammar.
OPEN = "<s>[INST] "
OPEN_ESCAPED = "<s>[INST+] "
MIDDLE = " [/INST]"
CLOSE = "</s>"
CONTROL = ("</s>", "<s>", "[INST", "[/INST]")


def escape(text: Column) -> Column:
    """Backslash codes for backslash, ``<`` and ``[``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit("["), F.lit("\\s"))


def unescape(text: Column) -> Column:
    # Each code is a backslash and a letter, and a plain backslash is a code
    # itself, so no two codes overlap and the order only needs it to come last.
    text = F.replace(text, F.lit("\\s"), F.lit("["))
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _conflicts(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in CONTROL])


def render(turns: Column, level: int) -> Column:
    """Text of the turns (array of role, text); level 1 escapes turns that hold a control string, 2 all."""

    def one(turn: Column) -> Column:
        plain = F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))
        safe = F.concat(
            F.lit(OPEN_ESCAPED), escape(turn["role"]), F.lit(MIDDLE), escape(turn["text"]), F.lit(CLOSE)
        )
        return safe if level == 2 else F.when(_in_conflict(turn), safe).otherwise(plain)

    return F.array_join(F.transform(turns, one), "")


def _in_conflict(turn: Column) -> Column:
    return _conflicts(turn["role"]) | _conflicts(turn["text"])


def parse(text: Column) -> Column:
    """Turns (array of role, text) of a rendered conversation; a piece that breaks the grammar gives a null turn."""

    def one(piece: Column) -> Column:
        safe = F.startswith(piece, F.lit(OPEN_ESCAPED))
        body = F.when(safe, F.substr(piece, F.lit(len(OPEN_ESCAPED) + 1))).when(
            F.startswith(piece, F.lit(OPEN)), F.substr(piece, F.lit(len(OPEN) + 1))
        )
        at = F.instr(body, MIDDLE)
        role = F.substr(body, F.lit(1), at - 1)
        content = F.substr(body, at + len(MIDDLE))
        return F.when(
            at > 0,
            F.struct(
                F.when(safe, unescape(role)).otherwise(role).alias("role"),
                F.when(safe, unescape(content)).otherwise(content).alias("text"),
            ),
        )

    pieces = F.split(text, F.lit(CLOSE))
    # A rendered text ends with the close mark, so the last piece is empty; anything else there is an error.
    complete = F.filter(pieces, lambda p, i: (i < F.size(pieces) - 1) | (p != ""))
    return F.transform(complete, one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rendered text of each conversation: conv_id, formatted, escape_level.

    Reads conv_id, turn, role, text; other columns play no part. Rows are ordered
    by turn (null first), ties by role and text, so repeated rows give repeated
    turns. Null role or text is empty. Rows without conv_id are one conversation
    of their own. An empty table gives an empty one. A conversation is one
    training example and one value of the result; it must fit in a row.
    """
    empty = F.lit("")
    gathered = rows.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
            )
        ).alias("turns")
    )
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    table = gathered.select("conv_id", turns.alias("turns"))
    table = table.withColumn("formatted", render(F.col("turns"), 1))
    same = parse(F.col("formatted")).eqNullSafe(F.col("turns"))
    level = F.when(~same, 2).when(F.exists("turns", _in_conflict), 1).otherwise(0)
    table = table.withColumn("escape_level", level)
    again = F.when(F.col("escape_level") == 2, render(F.col("turns"), 2)).otherwise(F.col("formatted"))
    return table.select("conv_id", again.alias("formatted"), "escape_level")


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Loss mask of a rendered conversation: (start, length, escaped) of each text of ``role``, in code points from 0."""
    pieces = F.split(formatted, F.lit(CLOSE))
    none = F.expr("CAST(array() AS array<int>)")
    starts = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), none.alias("all")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p) + len(CLOSE)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")
        ),
    )["all"]
    head = F.zip_with(
        pieces,
        starts,
        lambda p, at: F.struct(
            p.alias("piece"), at.alias("at"), (F.instr(p, MIDDLE) + (len(MIDDLE) - 1)).cast("int").alias("header")
        ),
    )
    mine = F.filter(
        head,
        lambda h: F.startswith(h["piece"], F.lit(f"{OPEN}{role}{MIDDLE}"))
        | F.startswith(h["piece"], F.lit(f"{OPEN_ESCAPED}{role}{MIDDLE}")),
    )
    return F.transform(
        mine,
        lambda h: F.struct(
            (h["at"] + h["header"]).alias("start"),
            (F.length(h["piece"]) - h["header"]).alias("length"),
            F.startswith(h["piece"], F.lit(OPEN_ESCAPED)).alias("escaped"),
        ),
    )


def read_back(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """What the parser recovers: turns, loss_spans (the mask's offsets) and loss_text (the text under it, unescaped)."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "loss_spans", loss_spans(F.col("formatted"), role)
    )

    def text(span: Column) -> Column:
        said = F.substr("formatted", span["start"] + 1, span["length"])
        return F.when(span["escaped"], unescape(said)).otherwise(said)

    return parsed.withColumn("loss_text", F.array_join(F.transform("loss_spans", text), ""))
