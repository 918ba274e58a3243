"""What the operators on public tokenizers share: texts in bounded slices, cut where no token crosses, and a memory of what was found."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Code points of the texts that are in Python's hands together (one longer text alone).
SLICE = 1 << 20
#: Chunks that a worker's memory takes until it turns over; two turns are held. Longer chunks do not outlast a turn.
MEMO = 1 << 18
MEMO_CHARS = 64

_CUT = re.compile(r"(?<=\S)(?= \S)")


def chunks_of(text: str) -> list[str]:
    """`text`, cut before each single space that stands between two characters that are not white space.

    Patterns of byte-level vocabularies always cut there, and pieces that mark a space only at
    their start begin there: tokens on both sides do not depend on each other.
    """
    parts = text.split(" ")
    if "" in parts or list(map(str.strip, parts)) != parts:
        return _CUT.split(text)
    return parts[:1] + [" " + p for p in parts[1:]]


def slices_of(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a binary column. Null: empty. What is not UTF-8 becomes U+FFFD."""
    first, out, chars = 0, [], 0
    for i, x in enumerate(column):
        data = x.as_py()
        text = data.decode("utf-8", "replace") if data else ""
        if out and chars + len(text) > SLICE:
            yield first, out
            first, out, chars = i, [], 0
        out.append(text)
        chars += len(text)
    if out:
        yield first, out


class Memo:
    """What `learn` finds for chunks; each is asked once while it is remembered. What was not asked for since the last turnover is forgotten."""

    def __init__(self, learn: Callable[[list[str]], Iterable[object]], size: int | None = None) -> None:
        self._learn, self._size, self._known, self._older = learn, size, {}, {}

    def of(self, texts: Iterable[list[str]]) -> dict[str, object]:
        """A dictionary that holds every chunk of `texts`."""
        known = self._known
        new = set().union(*texts).difference(known)
        again = new & self._older.keys()
        known.update((c, self._older[c]) for c in again)
        new = list(new - again)
        known.update(zip(new, self._learn(new) if new else (), strict=True))
        if len(known) > (self._size or MEMO):
            self._known, self._older = {}, {c: v for c, v in known.items() if len(c) <= MEMO_CHARS}
        return known
