"""Chat formatting from a declarative template, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a conversation is written, and in which order its roles may speak."""

    open: str = "<s>"
    after_role: str = "\n"
    close: str = "</s>"
    #: Strings that a text must not bring in. Inside texts and roles they become a backslash and a digit.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From each state, the roles that may come next; the role is the next state.
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    end_states: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.controls) > 10 or any("\\" in c or not c or any(x.isdigit() for x in c) for c in self.controls):
            raise ValueError("at most ten control strings, none with a backslash or digit")
        if not {self.open, self.close} <= set(self.controls):
            raise ValueError("the marks of a turn must be among the control strings")


def escape(text: Column, template: Template) -> Column:
    """Without control strings; ``unescape`` gives the text again."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for i, control in enumerate(template.controls):
        text = F.replace(text, F.lit(control), F.lit(f"\\{i}"))
    return text


def unescape(text: Column, template: Template) -> Column:
    def restore(piece: Column) -> Column:
        piece = F.replace(piece, F.lit("\\n"), F.lit("\n"))
        for i, control in enumerate(template.controls):
            piece = F.replace(piece, F.lit(f"\\{i}"), F.lit(control))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), restore), "\\")


def format_chats(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Template = Template(),
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, broken_at, segments, formatted.

    segments is an array of (text, role, loss), whose texts put together are ``formatted``; loss is
    true for the text of a loss role alone, not for its marks. A finite-state machine over the roles
    sets valid, and broken_at, the first turn out of order (0-based; null if none). A conversation out
    of order is formatted all the same. Turns go by number, null last; equal numbers by role and
    text. A null role or text is empty; repeated rows stay repeated. A null conv_id is one
    conversation. An empty table gives no rows. Other columns are ignored. A conversation is one
    output value, so its turns meet in one row.
    """
    one = F.struct(
        F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    moves = F.create_map(*[F.lit(x) for state, roles in template.turns.items() for r in roles for x in (f"{state}\n{r}", r)])

    def step(state: Column, t: Column) -> Column:
        following = F.try_element_at(moves, F.concat(state["state"], F.lit("\n"), t["role"]))
        broken = state["broken"].isNull() & following.isNull()
        return F.struct(
            F.coalesce(following, F.lit("?")).alias("state"),
            (state["n"] + 1).alias("n"),
            F.when(broken, state["n"]).otherwise(state["broken"]).alias("broken"),
        )

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("broken"))
    chats = chats.withColumn("end", F.aggregate("turns", start, step))

    def segment(value: Column, t: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), t["role"].alias("role"), loss.alias("loss"))

    def written(t: Column) -> Column:
        head = F.concat(F.lit(template.open), F.replace(escape(t["role"], template), F.lit("\n"), F.lit("\\n")), F.lit(template.after_role))
        no = F.lit(False)
        return F.array(
            segment(head, t, no), segment(escape(t["text"], template), t, t["role"].isin(*template.loss_roles)), segment(F.lit(template.close), t, no)
        )

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", written)))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        (F.col("end.broken").isNull() & F.col("end.state").isin(*template.end_states)).alias("valid"),
        F.col("end.broken").cast("long").alias("broken_at"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in template.close)
    pieces = F.filter(F.split(formatted, quoted), lambda p: p != "")
    mark = F.lit(template.after_role)

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.open) + 1))
        at = F.instr(body, template.after_role)
        return F.struct(
            unescape(F.substr(body, F.lit(1), at - 1), template).alias("role"), unescape(F.substr(body, at + F.length(mark)), template).alias("text")
        )

    return F.transform(pieces, parse)


def read_loss(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"], template)), "")
