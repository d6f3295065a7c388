"""Chat formatting by a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

ESC = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of each role, who may follow whom, and whose text carries loss.

    ``marks``: role to (opening, closing). A role without marks of its own is written between
    ``other`` marks with its name. ``follows``: state to the roles allowed next; a state is the
    last role, "" before the first. ``ends``: states in which a conversation may end.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})
    loss: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))


class Formatter:
    """Writes turns as segments with loss flags and reads formatted text back."""

    def __init__(self, template: Template):
        self.template = template
        either = "|".join(map(re.escape, template.controls))
        self._start = re.compile(f"(?=({either}))(.)", re.DOTALL)
        self._mark = re.compile(f"({either})")
        self._role_of = {a: r for r, (a, _) in template.marks.items()}

    def escape(self, text: str) -> str:
        """Doubles each backslash, then puts one behind the first character of each control string.

        No control string is left, and a single backslash can only come from the second step.
        """
        if ESC in text:
            text = text.replace(ESC, ESC * 2)
        return self._start.sub(lambda m: m[2] + ESC, text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", lambda m: m[1], text) if ESC in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        opening, closing = self.template.marks.get(role, ("", ""))
        body = (self.escape(text), role in self.template.loss)
        if opening:
            return [(opening, False), body, (closing, False)]
        a, b, c = self.template.other
        return [(a + self.escape(role) + b, False), body, (c, False)]

    def step(self, state: str, role: str) -> bool:
        """Whether the machine may go from the state to the role."""
        return role in self.template.follows.get(state, frozenset())

    def read(self, segments: list[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn of formatted segments, from marks and flags alone."""
        text = "".join(s for s, _ in segments)
        masked = "".join(s for s, on in segments if on)
        parts, at = self._mark.split(text), 1
        while at < len(parts):
            if parts[at] == self.template.other[0]:
                yield self.unescape(parts[at + 1]), self.unescape(parts[at + 3]), self.unescape(masked)
                at += 6
            else:
                yield self._role_of[parts[at]], self.unescape(parts[at + 1]), self.unescape(masked)
                at += 4


TURNS = "turn long, role string, valid boolean, ends boolean, segments array<struct<text:string,loss:boolean>>"


def _sorted_turns(rows: DataFrame) -> DataFrame:
    """All turns of a conversation in order in one partition; sorting spills, nothing is gathered."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, role, valid (the machine allows it after the turn before),
    ends (a conversation may end after it) and its segments with loss flags.

    Turns are taken in order of turn, then role, then text, so ties have one result; repeated rows
    are turns of their own (the second one is invalid). A null text or role is empty, a null turn
    comes first, rows with a null conv_id form one conversation, an empty table gives an empty one,
    other columns are left out. Turns stream through in sorted order with only the state kept, so a
    conversation of any length needs no more memory than a batch.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, conv, state = Formatter(template), object(), ""
        for batch in batches:
            valid, ends, segments = [], [], []
            roles = batch.column("role").to_pylist()
            for c, role, text in zip(batch.column("conv_id").to_pylist(), roles, batch.column("text").to_pylist(), strict=True):
                if c != conv:
                    conv, state = c, ""
                valid.append(fmt.step(state, role))
                state = role
                ends.append(role in template.ends)
                segments.append([{"text": s, "loss": on} for s, on in fmt.segments(role, text)])
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(valid, pa.bool_()), pa.array(ends, pa.bool_()), pa.array(segments, kind)], ["conv_id", "turn", "role", "valid", "ends", "segments"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return map_arrow(_sorted_turns(rows), run, f"conv_id {kind}, {TURNS}")


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``format_chat``'s rows, read back from their segments.

    Takes the partitions as ``format_chat`` leaves them, in order, and keeps running digests: those
    of one conversation are sequential by definition, but need no more memory than a batch.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt, conv, now = Formatter(template), object(), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_invalid", "complete"]
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            kinds[0] = batch.schema.field("conv_id").type
            done = []
            for c, valid, ends, segments in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "valid", "ends", "segments")), strict=True):
                if now is None or c != conv:
                    if now:
                        done.append(_row(conv, now))
                    conv, now = c, {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "bad": 0, "ends": False}
                pairs = [(s["text"], s["loss"]) for s in segments]
                for role, text, masked in fmt.read(pairs):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["loss"].update(masked.encode())
                    now["chars"] += len(masked)
                now["all"] += sum(len(s) for s, _ in pairs)
                now["bad"] += not valid
                now["ends"] = ends
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_row(conv, now), kinds, strict=True)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_arrow(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_invalid long, complete boolean")


def _row(conv, now: dict) -> tuple:
    return conv, now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"], now["bad"], now["bad"] == 0 and now["ends"]
