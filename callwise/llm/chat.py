"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans. Each window after the first repeats the system turn and a limited
history; repeated turns are outside the loss mask, so every assistant text is a target exactly once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks before and after a turn. A role without marks is written out between [ROLE] and [TEXT].
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = r"/?INST\]|/?ROLE\]|TEXT\]|/?s>|</?SYS>>"
ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>"
                  r"|\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]", re.DOTALL)
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens that the marks of a turn cost.
MARK_TOKENS = 4

WINDOW_SCHEMA = ("conv_id long, window long, text string, loss array<struct<start:int,end:int>>, "
                 "repeated int, turns int, tokens long")


def escape(text: str) -> str:
    """One backslash goes after the first character of each control string, which may have some already."""
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its text starts and ends."""
    body = escape(text)
    before, after = MARKS.get(role, (OTHER[0] + escape(role) + OTHER[1], OTHER[2]))
    return before + body + after, len(before), len(before) + len(body)


class Windower:
    """Cuts one conversation, turn by turn. Holds one window, its history and the system turn, not the conversation."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.sums = [0]
        self.first = 0  # of the turns held, the first new one
        self.window = self.seen = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, len(TOKEN.findall(text)) + MARK_TOKENS)
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        repeated_system = self.system[2] if self.system and self.window else 0
        room = self.budget - repeated_system - (self.sums[self.first] - self.sums[0])
        fits = bisect_right(self.sums, self.sums[self.first] + room) - 1
        if fits < len(self.turns) and len(self.turns) - self.first > 1:
            yield self.cut(len(self.turns) - 1)

    def cut(self, stop: int) -> tuple:
        """The window of the new turns up to ``stop``; turns that serve as history stay held."""
        shown = self.turns[:stop]
        repeated = self.first
        if self.system and self.window:
            shown, repeated = [self.system, *shown], repeated + 1
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(shown):
            piece, start, end = render(role, text)
            if role == "assistant" and i >= repeated:
                loss.append((at + start, at + end))
            parts.append(piece)
            at += len(piece)
        row = (self.window, "".join(parts), loss, repeated, len(shown), sum(t[2] for t in shown))
        # Keep the longest tail within the history budget; the system turn is repeated anyway.
        keep = bisect_left(self.sums, self.sums[stop] - self.history)
        if self.window == 0 and self.system:
            keep = max(keep, 1)
        self.turns, base = self.turns[keep:], self.sums[keep:]
        self.sums = [s - base[0] for s in base]
        self.first = stop - keep
        self.window += 1
        return row

    def end(self) -> Iterator[tuple]:
        if len(self.turns) > self.first:
            yield self.cut(len(self.turns))


def budgeted_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Rows conv_id, turn, role, text to formatted windows: conv_id, window, text, loss, repeated, turns, tokens.

    ``loss`` has the spans (code points) of new assistant texts; the first ``repeated`` turns of a window were
    shown before. A turn is never cut: one above the budget has a window of its own. Turns stand by (turn,
    role, text), null turns first; equal rows are turns of their own. Null texts and roles are empty, a null
    conv_id is a conversation, and an empty table gives none. A task streams through its conversations and
    holds one window at a time, however long a conversation is.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ("conv_id", "window", "text", "loss", "repeated", "turns", "tokens")]
        current, cutter = None, None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["conv_id"] = out["conv_id"].astype("Int64")
            out["loss"] = [[{"start": a, "end": b} for a, b in x] for x in out["loss"]]
            return out

        for batch in batches:
            made = []
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if cutter is None or conv != current:
                    if cutter is not None:
                        made += [(current, *w) for w in cutter.end()]
                    current, cutter = conv, Windower(budget, history)
                made += [(current, *w) for w in cutter.add(role, text)]
            if made:
                yield frame(made)
        if cutter is not None:
            yield frame([(current, *w) for w in cutter.end()])

    return ordered.mapInPandas(stream, WINDOW_SCHEMA)


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted window: role, text, and the span of the text as it stands."""
    out = []
    for m in TURN.finditer(text):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        out.append((role, unescape(m[kind]), m.start(kind), m.end(kind)))
    return out


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ordered = windows.select("conv_id", "window", "text", "loss", "repeated").repartition("conv_id").sortWithinPartitions(
        "conv_id", "window")
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        current, n, chars, lost, turns, loss = none, 0, 0, 0, None, None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            return out

        for batch in batches:
            done = []
            for conv, text, spans, repeated in zip(batch["conv_id"], batch["text"], batch["loss"], batch["repeated"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current:
                    if current is not none:
                        done.append((current, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
                    current, n, chars, lost, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in read_turns(text)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    said = unescape(text[span["start"]:span["end"]])
                    lost += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
                chars += len(text)
            if done:
                yield frame(done)
        if current is not none:
            yield frame([(current, n, turns.hexdigest(), lost, loss.hexdigest(), chars)])

    return ordered.mapInPandas(read, schema)
