"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template names the turn marks, the transitions between roles and the roles whose text is trained on. Each conversation
becomes a list of segments (text, loss); the formatted string is their concatenation. Control strings inside texts are
escaped so that no text can open or close a turn: between ``<`` and ``|`` one backslash is added to whatever backslashes
stand there, and taken away when reading, which is a bijection. Line feeds and backslashes inside role names are escaped too.

A conversation's turns meet in one row because its output is one string; conversations themselves spread over all tasks.

Defined results: null texts count as empty, null roles as the role ""; turns are ordered by turn, role, text with nulls
first, so ties and repeated rows have one order; conversations with a null id form one conversation; an order of roles
that the machine doesn't accept is formatted all the same and marked ``valid = false``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``before`` + role + ``between`` + text + ``after`` for each turn; ``moves`` maps (state, role) to the next state."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>"
    end: str = "\n"
    start_state: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("user", "assistant")
    loss_roles: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def final_state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; ``invalid`` once no move fits."""
    pairs = [x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    table = F.create_map(*pairs)
    return F.aggregate(
        roles, F.lit(template.start_state), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), r)), F.lit("invalid"))
    )


def segments(turns: DataFrame, template: Template = CHATML, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``valid``, ``segments`` (array of text, loss), ``formatted``."""
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    convs = turns.select(F.col(conv_col).alias("conv"), row.alias("t")).groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def part(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(template.before), escape_role(t["role"]), F.lit(template.between))
        body = F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss"))
        return F.array(part(head, False), body, part(F.lit(template.after + template.end), False))

    out = convs.select(
        F.col("conv").alias(conv_col), final_state(F.transform("ts", lambda t: t["role"]), template).isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("ts", of_turn)).alias("segments"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """The turns (array of role, text) that the formatted string holds, and the text under the loss mask, unescaped."""
    pieces = F.split("formatted", "\\Q" + template.before + "\\E")  # escaped texts hold no mark
    bodies = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    tail = len(template.after + template.end)

    def turn(body: Column) -> Column:
        at = F.locate(template.between, body)
        inner = F.substring(body, F.lit(1), F.length(body) - tail)
        return F.struct(
            unescape_role(F.substring(inner, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(inner, at + len(template.between), F.length(inner))).alias("text"),
        )

    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumn("turns", F.transform(bodies, turn)).withColumn("loss_text", F.array_join(trained, ""))


def digest(formatted: DataFrame, template: Template = CHATML, *, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid; all read back from the output."""
    back = read_back(formatted, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
