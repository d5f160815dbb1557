r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as turns `### <role>[!]: <text> </turn>\n`.  The grammar is regular:
a turn starts at the text's start or after an end mark, its head ends at the first `: `, its text
at the first end mark.  The parser splits at end marks, cuts each part's head, and undoes the
escapes of turns whose head has the `!` flag.

Each conversation is first rendered plainly and parsed again.  Turns whose conversation comes
back different (their texts or roles hold control strings) are escaped, which puts a backslash
into every control string, flagged, rendered and parsed anew; escaped content holds no control
string, so the second pass is identical always; `identical` tells it of every conversation, and
`proven` ends a run in which one is not.

Rows are turns: ordered by turn, then role and text, nulls first; null roles and texts count as
empty.  All rows of a null conv_id are one conversation.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import clash_free

#: The template's control strings.
HEAD, FLAG, SEP, END = "### ", "!", ": ", " </turn>\n"


def _escape(x: Column) -> Column:
    r"""Backslashes are doubled; `/` becomes `\s`, `:` `\c`, `!` `\b`, `#` `\h`: no control string is left."""
    for plain, code in (("\\", "\\\\"), ("/", "\\s"), (":", "\\c"), ("!", "\\b"), ("#", "\\h")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def _unescape(x: Column) -> Column:
    # \x00 may stand in a text, so doubled backslashes are set apart by splitting at them.
    def part(p: Column) -> Column:
        for plain, code in (("/", "\\s"), (":", "\\c"), ("!", "\\b"), ("#", "\\h")):
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), part), "\\")


def _render(turns: Column, escaped: Column) -> Column:
    def one(t: Column) -> Column:
        return F.concat(F.lit(HEAD), F.when(escaped, F.concat(_escape(t["role"]), F.lit(FLAG))).otherwise(t["role"]), F.lit(SEP), F.when(escaped, _escape(t["text"])).otherwise(t["text"]), F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, from its characters alone."""
    parts = F.split(formatted, END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(p: Column) -> Column:
        at = F.locate(SEP, p)
        head = F.substring(p, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1))
        body = F.substring(p, at + len(SEP), F.length(p))
        flagged = head.endswith(FLAG)
        role = F.substring(head, F.lit(1), F.length(head) - len(FLAG))
        return F.struct(F.when(flagged, _unescape(role)).otherwise(head).alias("role"), F.when(flagged, _unescape(body)).otherwise(body).alias("text"))

    return F.transform(parts, one)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, parsed, identical) of conversations given as rows (conv_id, turn, role, text)."""
    turns = clash_free(turns, "conv_id", "turn", "role", "text")
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    chats = chats.withColumn("formatted", _render(F.col("turns"), F.lit(False)))
    chats = chats.withColumn("formatted", F.when(parse(F.col("formatted")) == F.col("turns"), F.col("formatted")).otherwise(_render(F.col("turns"), F.lit(True))))
    chats = chats.withColumn("parsed", parse(F.col("formatted")))
    return chats.select("conv_id", "formatted", "parsed", (F.col("parsed") == F.col("turns")).alias("identical"))


def proven(chats: DataFrame) -> DataFrame:
    """chats; a conversation that does not come back from its formatted text ends the run with an error."""
    error = F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return chats.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(error))


def loss_spans(parsed: Column, role: str = "assistant") -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(F.filter(parsed, lambda t: t["role"] == role), lambda t: t["text"])
