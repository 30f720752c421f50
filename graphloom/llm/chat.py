"""Chat formatting by a finite-state machine over roles and a declarative template; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles whose text bears the loss, and the machine that turn order must follow.

    A turn reads start + role + middle + text + end. Role and text are escaped, so that no mark stands inside them:
    `escape` becomes escape + "0", and the first character of each mark becomes escape + its place in `starts` + 1.
    machine: (state, role, next state, whether the turn's text bears the loss). A role without a next state makes the conversation
    invalid from that turn on; such turns bear the loss by loss_roles.
    """

    start: str = "[INST:"
    middle: str = "] "
    end: str = "</s>"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    begin: str = "start"
    machine: tuple[tuple[str, str, str, bool], ...] = (
        ("start", "system", "instructed", False), ("start", "user", "asked", False), ("instructed", "user", "asked", False),
        ("asked", "assistant", "answered", True), ("answered", "user", "asked", False),
    )
    accepting: tuple[str, ...] = ("answered",)

    @property
    def starts(self) -> str:
        return "".join(dict.fromkeys(m[0] for m in (self.start, self.middle, self.end)))


def escaped(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    for i, c in enumerate(t.starts):
        out = F.replace(out, F.lit(c), F.lit(f"{t.escape}{i + 1}"))
    return out


def unescaped(text: Column, t: Template) -> Column:
    out = text
    for i, c in enumerate(t.starts):
        out = F.replace(out, F.lit(f"{t.escape}{i + 1}"), F.lit(c))
    return F.replace(out, F.lit(t.escape + "0"), F.lit(t.escape))


BLOCK = 256  # turns that the machine reads between two copies of what it has emitted
BROKEN = "!"  # the state after a turn without a next state


def _machine(turns: Column, t: Template) -> Column:
    """struct<state, out>: the machine's state after all turns, and for each turn struct<state, loss>, the state after it and its loss flag.

    The machine reads blocks of turns, so what it emits is copied once a block and not once a turn.
    """
    emitted = "array<struct<state:string,loss:boolean>>"

    def step(at: Column, turn: Column) -> Column:
        state, loss = F.lit(BROKEN), turn["role"].isin(*t.loss_roles)
        for a, role, b, flag in t.machine:
            here = (at["state"] == a) & (turn["role"] == role)
            state, loss = F.when(here, F.lit(b)).otherwise(state), F.when(here, F.lit(flag)).otherwise(loss)
        return F.struct(state.alias("state"), F.concat(at["out"], F.array(F.struct(state.alias("state"), loss.alias("loss")))).alias("out"))

    def block(at: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(at["state"].alias("state"), F.array().cast(emitted).alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["state"].alias("state"), F.concat(at["out"], F.array(x["out"])).alias("out"))), F.lit(0))

    starts = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / F.lit(BLOCK)).cast("int"))  # a conversation has a turn
    blocks = F.transform(starts, lambda k: F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)))
    return F.aggregate(blocks, F.struct(F.lit(t.begin).alias("state"), F.array().cast(f"array<{emitted}>").alias("out")), block, lambda at: F.struct(at["state"].alias("state"), F.flatten(at["out"]).alias("out")))


def format_chats(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_col, n_turns, valid, bad_turn, segments array<struct<text, loss>>, formatted (all segments, joined).

    Rows go by turn, then role, then text; nulls in turn go first, null role or text is empty, rows with a null conversation form one.
    Repeated rows are repeated turns. The template's machine reads the roles in order and emits each turn's segments with their loss
    flags. valid: it ends in an accepting state; bad_turn: the place (from 0) of the first turn without a next state, or n_turns where
    the conversation only ends too early, null where it is valid. Other conversations are formatted too. An empty table gives none;
    other columns don't enter. A conversation becomes one row, as its text is one sequence: one of unbounded length has to fit a task,
    whatever the source. Conversations are the shuffle's key; copies of a conversation under other ids are other keys.
    """
    t = template or Template()
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = df.select(q(conv_col).alias("_conv"), F.struct(q(turn_col).alias("turn"), F.coalesce(q(role_col), F.lit("")).alias("role"), F.coalesce(q(text_col), F.lit("")).alias("text")).alias("_turn"))
    chats = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    chats = chats.select("_conv", "_turns", _machine(F.col("_turns"), t).alias("_run"))
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    emitted = F.zip_with(
        "_turns", "_run.out",
        lambda x, at: F.array(
            segment(F.concat(F.lit(t.start), escaped(x["role"], t), F.lit(t.middle)), F.lit(False)),
            segment(escaped(x["text"], t), at["loss"]),
            segment(F.lit(t.end), F.lit(False)),
        ),
    )
    n = F.size("_run.out").cast("long")
    broken = F.array_position(F.transform("_run.out", lambda x: x["state"]), BROKEN)
    valid = F.col("_run.state").isin(*t.accepting)
    bad = F.when(broken > 0, broken - 1).when(~valid, n).cast("long")
    chats = chats.select(F.col("_conv").alias(conv_col), n.alias("n_turns"), valid.alias("valid"), bad.alias("bad_turn"), F.flatten(emitted).alias("segments"))
    return chats.select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns array<struct<role, text>> that a formatted conversation holds."""
    t = template or Template()
    turns = F.slice(F.split(formatted, _quoted(t.end)), 1, F.size(F.split(formatted, _quoted(t.end))) - 1)

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(t.start) + 1))
        at = F.instr(body, t.middle)
        return F.struct(unescaped(F.substr(body, F.lit(1), at - 1), t).alias("role"), unescaped(F.substr(body, at + len(t.middle)), t).alias("text"))

    return F.transform(turns, turn)


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"
