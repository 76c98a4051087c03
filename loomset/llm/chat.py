"""Chat formatting from a declarative template: role order by a finite-state machine, text segments with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are marked. Every control string starts with marker; in roles and texts marker is escaped."""

    turn_start: str = "<|im_start|>"
    turn_end: str = "<|im_end|>\n"
    marker: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; any other step is an error, which stays.
    steps: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    """Double every backslash and put one inside the marker, so that no control string can occur. unescape() reverses it."""
    m = template.marker
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(m), F.lit(f"{m[0]}\\{m[1:]}"))


def unescape(text: Column) -> Column:
    """Drop each backslash that stands before a character, and keep that character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>, formatted): one row for each conversation.

    Turns run by their number, null first; of equal numbers by role and text. Null roles and texts are empty. Repeated
    rows are turns of their own. valid: the roles lead the template's machine to an accepting state; other
    conversations are formatted just so. segments put together are the formatted text; loss marks the texts of
    loss_roles alone. A conversation is one row, so its turns meet in one task. An empty table gives no row.
    """
    m = template.marker
    named = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    grouped = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    if not all(x.startswith(m) for x in (template.turn_start, template.turn_end)):
        raise ValueError("every control string must start with the marker")
    table = F.create_map(*chain.from_iterable((F.lit(f"{s}\n{r}"), F.lit(to)) for (s, r), to in template.steps.items()))
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: F.coalesce(F.element_at(table, F.concat(s, F.lit("\n"), t["role"])), F.lit("error")))
    # a line feed ends the role, so one inside a role is escaped too
    head = lambda t: F.concat(F.lit(template.turn_start), F.replace(escape(t["role"], template), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    part = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    cut = F.flatten(F.transform("turns", lambda t: F.array(part(head(t), F.lit(False)), part(escape(t["text"], template), t["role"].isin(*template.loss_roles)), part(F.lit(template.turn_end), F.lit(False)))))
    made = grouped.select("conv_id", state.isin(*template.accept).alias("valid"), cut.alias("segments"))
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> of the turns in a formatted text, unescaped."""
    parts = F.split(formatted, re.escape(template.turn_end).replace("\\\n", "\n"))
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.substr(x, F.lit(len(template.turn_start) + 1)))
    role = lambda x: F.regexp_extract(x, r"(?s)\A((?:[^\\\n]++|\\.)*+)\n", 1)
    return F.transform(turns, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
