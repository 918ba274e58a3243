"""Fusion of per-frame reads over a window: a vote by margin with decay, a latch, and honest staleness.

A card's slot is fixed on the board, so each slot of each window is an automaton of its own:

* a read votes for its identity with its margin as weight; older votes have decayed by the time
  since, not by frames. Reads that abstain vote for nothing, but the slot has been seen;
* once an identity has SUPPORT, the slot is revealed and holds it. It flips only after FLIPS confident
  reads in a row of one other identity; reads that abstain or are not confident are passed over;
* frames that are no board give no read: the slot keeps what it has, and says since when.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.scalar import UNKNOWN

#: Settings, not measurements: decay a second, support that reveals, margin of a confident read, reads that flip.
DECAY, SUPPORT, CONFIDENT, FLIPS = 0.05, 1.0, 0.12, 3
FACE_DOWN = "face_down"
ABSTAINS = (UNKNOWN, FACE_DOWN)
BOARD = "board"


@dataclass
class Rules:
    decay: float = DECAY
    support: float = SUPPORT
    confident: float = CONFIDENT
    flips: int = FLIPS


@dataclass
class Belief:
    """What is held of one slot."""

    weights: dict[str, float] = field(default_factory=dict)
    at: float = 0.0
    latched: str | None = None
    contrary: str | None = None
    run: int = 0
    last_seen: int | None = None
    n: int = 0

    def read(self, seconds: float, frame: int, identity: str | None, margin: float | None, rules: Rules) -> None:
        """The next read, in order of time."""
        fade = math.exp(-rules.decay * (seconds - self.at)) if self.n else 1.0
        self.weights = {k: w * fade for k, w in self.weights.items()}
        votes = identity is not None and identity not in ABSTAINS and margin is not None and margin > 0
        if votes:
            self.weights[identity] = self.weights.get(identity, 0.0) + margin
        self.at, self.last_seen, self.n = seconds, frame, self.n + 1
        if self.latched is None:
            top = self.top()
            if top is not None and self.weights[top] >= rules.support:
                self.latched = top
        elif votes and margin >= rules.confident:
            self.run = 0 if identity == self.latched else self.run + 1 if identity == self.contrary else 1
            self.contrary = None if identity == self.latched else identity
            if self.run >= rules.flips:
                self.latched, self.contrary, self.run = identity, None, 0

    def top(self) -> str | None:
        return min(self.weights, key=lambda k: (-self.weights[k], k)) if self.weights else None

    def card(self) -> tuple:
        """(identity, confidence, support, revealed, last_seen_frame, n_reads): confidence is the held identity's lead over the best other, 0 at least."""
        name = self.latched or self.top()
        support = self.weights.get(name, 0.0) if name else 0.0
        other = max((w for k, w in self.weights.items() if k != name), default=0.0)
        return name or UNKNOWN, max(support - other, 0.0), support, self.latched is not None, self.last_seen, self.n


CARD_KINDS = "identity string, confidence double, support double, revealed boolean, last_seen_frame long, n_reads long"
_CARD_TYPES = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())


def window_of(seconds: Column, length: float) -> Column:
    """The window, from 0 at 1970, of a time."""
    return F.floor(seconds / length).cast("long")


def _folded(reads: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """Sorted reads (keys..., seconds, frame, identity, margin) -> one row (keys..., card) a slot; one slot's belief is held at a time."""
    kinds = dict(reads.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in keys]
                yield from zip(*[batch.column(c).to_pylist() for c in (*keys, "seconds", "frame", "identity", "margin")], strict=True)

        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, *_CARD_TYPES], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, *(c.split()[0] for c in CARD_KINDS.split(", "))])

        for key, group in groupby(rows(), itemgetter(*range(len(keys)))):
            belief = Belief()
            for row in group:
                belief.read(*row[len(keys) :], rules)
            out.append((*key, *belief.card()))
            if len(out) >= 4096:
                yield told()
                out = []
        if out:
            yield told()

    return reads.mapInArrow(walk, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {CARD_KINDS}")


def fused(frames: DataFrame, reads: DataFrame, session: str, length: float, rules: Rules | None = None) -> DataFrame:
    """One row a slot of a session's window of `length` seconds.

    frames (session, frame, seconds, state): one row a frame. reads (session, frame, slot,
    identity, margin): what board frames showed; reads of other frames are not looked at.

    (session, window, slot, identity, confidence, support, revealed, last_seen_frame, n_reads,
    staleness_frames, fused_from, first_frame, last_frame). staleness_frames: frames of the window
    after the slot's last read, of any state; fused_from: board frames of the window. Reads of
    equal times are taken by frame, identity and margin. A window without board frames has no
    rows. A slot is one task's only for the length of a window.
    """
    frames = frames.select(session, "frame", "seconds", "state", window_of(F.col("seconds"), length).alias("window"))
    keys = [session, "window", "slot"]
    board = frames.where(F.col("state") == BOARD).select(session, "frame", "seconds", "window")
    seen = reads.select(session, "frame", "slot", "identity", "margin").join(board, [session, "frame"])
    cards = _folded(seen.repartition(*keys).sortWithinPartitions(*keys, "seconds", "frame", "identity", "margin"), keys, rules or Rules())
    spans = frames.groupBy(session, "window").agg(F.count_if(F.col("state") == BOARD).alias("fused_from"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    # How many frames of the window come after each: one row a frame, whatever the number of slots.
    after = frames.select(session, "window", F.col("frame").alias("last_seen_frame"), (F.row_number().over(Window.partitionBy(session, "window").orderBy(F.desc("frame"))) - 1).cast("long").alias("staleness_frames"))
    return cards.join(spans, [session, "window"]).join(after, [session, "window", "last_seen_frame"])
