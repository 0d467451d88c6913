"""Chat formatting: a state machine over roles, and text segments with loss flags.

Everything is DataFrame functions. A conversation is one row, since its digest
needs all its turns in order; conversations are spread by their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, what is trained on, and which turn may follow which.

    ``head`` and ``tail`` stand around every text; ``{role}`` is the role. Texts
    and roles are escaped, so that no text can hold a head or a tail: each must
    have a ``<``, which no escaped text has. ``moves`` maps a state ("" at the
    beginning, else the role before) to the roles that may come next; ``ends``
    are the states in which a conversation may end.
    """

    head: str = "<turn {role}>"
    tail: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


#: The control characters of the template, and how texts write them.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _machine(roles: Column, template: Template) -> Column:
    """The state after the last role; null once a role came out of turn."""
    allowed = F.array(*[F.lit(f"{state}\n{role}") for state, roles_ in template.moves.items() for role in roles_])
    step = lambda state, role: F.when(F.array_contains(allowed, F.concat(state, F.lit("\n"), role)), role)
    return F.aggregate(roles, F.lit(""), lambda state, role: F.when(state.isNotNull(), step(state, role)))


def chat_format(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, valid, segments, formatted`` for each conversation in ``turns``.

    Turns are ordered by turn, then role, then text (repeated rows stay, side by
    side). ``segments`` are (text, loss) in order, ``formatted`` is their texts
    joined; ``valid`` tells whether the roles follow the template's moves and
    end where they may. Invalid conversations are formatted too. Null texts and
    roles are empty; a null conv_id is a conversation like any other; an empty
    table gives no rows; other columns are ignored.
    """
    before, after = template.head.split("{role}")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(before), escaped(t["role"]), F.lit(after))
        return F.array(segment(head, F.lit(False)), segment(escaped(t["text"]), t["role"].isin(*template.loss_roles)), segment(F.lit(template.tail), F.lit(False)))

    state = _machine(F.transform("turns", lambda t: t["role"]), template)
    return chats.select(
        "conv_id",
        F.coalesce(state.isin(*template.ends), F.lit(False)).alias("valid"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, roles, texts, loss_text`` parsed from what ``chat_format`` gave.

    Roles and texts come from the formatted string alone, the loss text from the
    segments under the loss mask; all are unescaped.
    """
    before, after = template.head.split("{role}")
    pattern = F.lit(rf"\Q{before}\E([^<>]*)\Q{after}\E([^<]*)\Q{template.tail}\E")
    found = lambda group: F.transform(F.regexp_extract_all("formatted", pattern, F.lit(group)), unescaped)
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"])
    return chats.select("*", found(1).alias("roles"), found(2).alias("texts"), unescaped(F.array_join(masked, "")).alias("loss_text"))


def chat_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid``, read back from the output."""
    back = read_back(chat_format(turns, template), template)
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
