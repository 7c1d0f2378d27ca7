"""Chat formatting by a declarative template and a finite-state machine over roles.

A template gives each role the strings around its text and says whether the text
counts for the loss.  Control strings inside texts are broken by a backslash after
their first character and backslashes are doubled, so no text can pass for a marker
and reading back restores each text exactly.

The machine walks the roles of a conversation in turn order.  A turn that the state
does not allow is flagged, the machine starts anew after it, and the turn is still
written: validation reports, it drops nothing.

Conversations stream: rows come sorted, and a worker holds one batch of turns and a
few running values, so a conversation may be of any length.

Defined results: a null text is empty, a null role is the empty role; turns with
equal numbers follow by role and text; repeated rows are turns of their own; a null
conversation id is one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import safe_id


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    #: For roles that are not listed; the role's name stands between the first two.
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE]", "[/TURN]")
    begin: str = "<s>"
    #: (state, role) -> state, and the states in which a conversation may end.
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    start: str = "start"
    accept: frozenset[str] = frozenset()

    def __post_init__(self):
        for s in self.controls():
            if len(s) < 2 or "\\" in s or any(s[:k] == s[-k:] for k in range(1, len(s))):
                raise ValueError(f"control string {s!r} is too short, has a backslash, or ends as it begins")
        if len({r.before for r in self.roles.values()} | {self.other[0]}) != len(self.roles) + 1:
            raise ValueError("two roles begin alike")

    def controls(self) -> list[str]:
        every = [self.begin, *self.other, *(s for r in self.roles.values() for s in (r.before, r.after))]
        return sorted({s.strip() for s in every}, key=lambda s: (-len(s), s))

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls())))


#: Instruction turns in brackets, answers closed by an end mark; answers alone count for the loss.
INSTRUCT = Template(
    roles={"system": Role("<<SYS>>\n", "\n<</SYS>>"), "user": Role("[INST] ", " [/INST]"), "assistant": Role("[ANS] ", "</s>", loss=True)},
    moves={("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"},
    accept=frozenset({"asked", "answered"}),
)


def escape(text: str, controls: re.Pattern) -> str:
    return controls.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turn_segments(role: str, text: str, template: Template, controls: re.Pattern) -> list[tuple[str, bool]]:
    """(text, counts for the loss) of one turn's segments: marker, text, marker."""
    if (r := template.roles.get(role)) is not None:
        return [(r.before, False), (escape(text, controls), r.loss), (r.after, False)]
    a, b, c = template.other
    return [(f"{a}{escape(role, controls)}{b}", False), (escape(text, controls), False), (c, False)]


def read_turns(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    if not formatted.startswith(template.begin):
        raise ValueError("no begin mark")
    at, out = len(template.begin), []
    while at < len(formatted):
        role = next((n for n, r in template.roles.items() if formatted.startswith(r.before, at)), None)
        if role is not None:
            r = template.roles[role]
            at += len(r.before)
            after = r.after
        else:
            a, b, after = template.other
            if not formatted.startswith(a, at):
                raise ValueError(f"no turn at {at}")
            end = formatted.index(b, at + len(a))
            role, at = unescape(formatted[at + len(a) : end]), end + len(b)
        end = formatted.index(after, at)
        out.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return out


SEGMENT = "conv_id long, turn long, segment int, role string, text string, loss boolean, allowed boolean, state string"


def segments(df: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Text segments with loss flags, in order within each conversation and all of one conversation in one partition.

    `turn` counts from 0 and is -1 for the begin mark; `allowed` and `state` are the
    machine's.  A null conversation id comes out as the smallest long.
    """
    d = df.select(safe_id(F.col(conv)).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        controls, now, k, state, seg = template.pattern(), None, 0, template.start, 0
        for b in batches:
            out = []
            for c, r, t in b.itertuples(index=False, name=None):
                if c != now:
                    now, k, state, seg = c, 0, template.start, 1
                    out.append((c, -1, 0, "", template.begin, False, True, state))
                to = template.moves.get((state, r))
                state = template.start if to is None else to
                for s, loss in turn_segments(r, t, template, controls):
                    out.append((c, k, seg, r, s, loss, to is not None, state))
                    seg += 1
                k += 1
            yield pd.DataFrame(out, columns=["conv_id", "turn", "segment", "role", "text", "loss", "allowed", "state"])

    return d.mapInPandas(write, SEGMENT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segs: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, figures and digests read from its formatted text, turn by turn."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, last = None, [], -1
        n = chars = loss_chars = 0
        turns, counted = hashlib.sha256(), hashlib.sha256()
        valid, state, begun = True, template.start, False

        def close_turn():
            nonlocal n
            if part:
                (role, text), = read_turns(template.begin + "".join(part), template)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
                part.clear()

        def close():
            close_turn()
            return (now, n, turns.hexdigest(), loss_chars, counted.hexdigest(), chars, valid and state in template.accept)

        for b in batches:
            out = []
            for c, k, _, _, s, in_loss, allowed, at in b.itertuples(index=False, name=None):
                if not begun or c != now:
                    if begun:
                        out.append(close())
                    now, n, chars, loss_chars, valid, begun = c, 0, 0, 0, True, True
                    turns, counted, last = hashlib.sha256(), hashlib.sha256(), -1
                chars += len(s)
                valid, state = valid and allowed, at
                if k < 0:
                    continue
                if k != last:
                    close_turn()
                    last = k
                part.append(s)
                if in_loss:
                    plain = unescape(s)
                    loss_chars += len(plain)
                    counted.update(plain.encode("utf-8", "surrogatepass"))
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in DIGEST.split(", ")])
        if begun:
            yield pd.DataFrame([close()], columns=[x.split()[0] for x in DIGEST.split(", ")])

    return segs.mapInPandas(read, DIGEST)
