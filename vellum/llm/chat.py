"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A machine over roles and, for each of its states, what a turn that leads there looks like.

    A turn in state s is open + role + after_role + text + close; its text bears the loss if s is in `learn`. The
    machine follows `moves`; a role that has no move from the present state is out of order, and the machine goes on
    from the role's state in `entry`, or from "other". A conversation is valid if no turn is out of order and it ends
    in a final state. `control` are the strings that a model reads as control; the first characters of these and of
    the marks are escaped inside roles and texts, so none of them can arise there and unescaping gives the text back.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
    #: Escape character and the letter that stands for each escaped character, the escape character's own last.
    escape: tuple[tuple[str, str], ...] = (("<", "\\l"), ("[", "\\b"), ("\\", "\\e"))
    start: str = "start"
    #: (state, role) -> state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "instructed",
            ("start", "user"): "asked",
            ("instructed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    #: Role -> state after a turn out of order.
    entry: dict[str, str] = field(default_factory=lambda: {"system": "instructed", "user": "asked", "assistant": "answered"})
    learn: tuple[str, ...] = ("answered",)
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        escaped = {a for a, _ in self.escape}
        for mark in (*self.control, self.open, self.close):
            if mark[0] not in escaped:
                raise ValueError(f"{mark!r} could arise inside a text")

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *self.moves.values(), *self.entry.values(), "other"]))


def escaped(c: Column, t: Template) -> Column:
    for plain, coded in reversed(t.escape):  # the escape character first
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescaped(c: Column, t: Template) -> Column:
    for plain, coded in t.escape:  # the escape character last
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _role_out(c: Column, t: Template) -> Column:
    return F.replace(escaped(c, t), F.lit("\n"), F.lit("\\n"))


def _role_back(c: Column, t: Template) -> Column:
    return unescaped(F.replace(c, F.lit("\\n"), F.lit("\n")), t)


def run_machine(roles: Column, t: Template) -> Column:
    """The state and order of each turn, folded over the roles: an array of (state, in_order)."""
    code = {s: chr(97 + k) for k, s in enumerate(t.states)}  # a letter to each state, a capital one out of order
    pairs = {f"{code[s]}{role}": code[to] for (s, role), to in t.moves.items()}
    again = {role: code[s].upper() for role, s in t.entry.items()}
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    other = F.lit(code["other"].upper())

    def step(acc: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table(pairs), F.concat(acc["now"], role)), F.try_element_at(table(again), role), other)
        return F.struct(F.lower(to).alias("now"), F.concat(acc["trace"], to).alias("trace"))

    trace = F.aggregate(roles, F.struct(F.lit(code[t.start]).alias("now"), F.lit("").alias("trace")), step, lambda acc: acc["trace"])
    names = table({c: s for s, c in code.items()})
    letters = F.filter(F.split(trace, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.struct(F.element_at(names, F.lower(c)).alias("state"), (c == F.lower(c)).alias("in_order")))


def format_chats(turns: DataFrame, t: Template | None = None) -> DataFrame:
    """Rows (conv_id, valid, state, out_of_order, segments): segments are (text, loss) in order; their texts make up the output.

    `turns` has (conv_id, turn, role, text). Turns go by turn, then role and text; a null turn comes first. A null
    text or role is empty. The machine gives each turn its state; the state decides the turn's segments and which of
    them bears the loss. `state` is the last one, `out_of_order` counts turns without a move. Invalid conversations
    are formatted all the same, the caller decides. Repeated rows are turns of their own. A null conv_id is one
    conversation. A conversation is one output value, so its turns meet in one row. Other columns are not read and don't
    come back; an empty table gives an empty result.
    """
    t = t or Template()
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.withColumn("path", run_machine(F.transform("turns", lambda x: x["role"]), t))

    def pieces(x: Column) -> Column:
        head = F.concat(F.lit(t.open), _role_out(x["turns"]["role"], t), F.lit(t.after_role))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escaped(x["turns"]["text"], t), x["path"]["state"].isin(*t.learn)), piece(F.lit(t.close), F.lit(False)))

    state = F.coalesce(F.try_element_at("path", F.lit(-1))["state"], F.lit(t.start))
    faults = F.size(F.filter("path", lambda x: ~x["in_order"])).cast("long")
    return convs.select(
        "conv_id",
        ((faults == 0) & state.isin(*t.final)).alias("valid"),
        state.alias("state"),
        faults.alias("out_of_order"),
        F.flatten(F.transform(F.arrays_zip("turns", "path"), pieces)).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(text: Column, t: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    t = t or Template()
    parts = F.filter(F.split(text, _quoted(t.close)), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(t.open) + 1), F.length(p))
        role = F.substring_index(body, t.after_role, 1)
        rest = F.substring(body, F.length(role) + F.lit(len(t.after_role) + 1), F.length(body))
        return F.struct(_role_back(role, t).alias("role"), unescaped(rest, t).alias("text"))

    return F.transform(parts, turn)


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() and c != "_" else c for c in s)


def loss_text(segments: Column, t: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = t or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
