"""Windowed fusion of reads as a stream: a slot's card comes out when its window is over."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.fusion import BOARD, CARD_KINDS, Belief, Rules, window_of
from gleaner.streaming.ordered import LATE, folded


class _Cards:
    """State: a slot's belief, the frames of any state since its last read, and those of the window."""

    def __init__(self, rules: Rules) -> None:
        self._rules = rules

    def step(self, state: dict | None, row: tuple) -> tuple[dict, list[tuple]]:
        seconds, frame, slot, board, identity, margin = row
        state = state or {"slots": {}, "frames": [], "fused_from": 0, "last": None}
        first = frame != state["last"]
        if first:  # rows of a frame follow each other
            state["last"] = frame
            state["fused_from"] += board
            state["frames"] = [min([frame, *state["frames"][:1]]), max([frame, *state["frames"][1:]])]
            for held in state["slots"].values():
                held["stale"] += 1
        if board and slot >= 0:
            held = state["slots"].setdefault(slot, {"belief": asdict(Belief()), "stale": 0})
            belief = Belief(**held["belief"])
            belief.read(seconds, frame, identity or None, margin, self._rules)
            held.update(belief=asdict(belief), stale=0)
        return state, []

    def end(self, state: dict | None) -> list[tuple]:
        state = state or {"slots": {}}
        return [(slot, *Belief(**held["belief"]).card(), held["stale"], state["fused_from"], *state["frames"]) for slot, held in sorted(state["slots"].items())]


def fused_stream(reads: DataFrame, session: str, length: float, rules: Rules | None = None, late: float = LATE) -> DataFrame:
    """What `fusion.fused` gives, from one stream (session, frame, seconds, state, slot, identity, margin): a row a read, and a row with slot null for a frame without reads.

    Frames of a session come with rising numbers. A window's cards are out, and its state is gone,
    once the watermark is `length` seconds past its newest frame.
    """
    rows = reads.select(
        session, window_of(F.col("seconds"), length).alias("window"), "seconds", "frame", F.coalesce(F.col("slot").cast("long"), F.lit(-1)).alias("slot"), (F.col("state") == BOARD).cast("int").alias("board"),
        F.coalesce("identity", F.lit("")).alias("identity"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
    )
    columns = ["seconds", "frame", "slot", "board", "identity", "margin"]
    kinds = f"slot long, {CARD_KINDS}, staleness_frames long, fused_from long, first_frame long, last_frame long"
    return folded(rows, [session, "window"], columns, _Cards(rules or Rules()), kinds, late, length)
