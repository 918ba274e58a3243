"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A piece is a run of whole texts of about PIECE bytes (one text at least), so memory follows the
piece and not the batch. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1024, 0xD6E8FEB86659FD93, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def follow(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of the sequence `h` with `nxt` after it."""
    return mix(h * _MUL + nxt)


@dataclass
class Piece:
    first: int  # row of the batch that the piece starts with
    buf: np.ndarray  # bytes of its texts
    offs: np.ndarray  # where each text starts; one more: the end

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the piece
    ends: np.ndarray
    bounds: np.ndarray  # of each text: its first word; one more: the end

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """The texts of a column (null: empty) in pieces."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Piece(at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at])
        at = end


def words(p: Piece) -> Words:
    """Whitespace-delimited words; none spans two texts."""
    solid = ~_SPACE[p.buf]
    before, after = np.ones(len(solid), bool), np.ones(len(solid), bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    inner = p.offs[(p.offs > 0) & (p.offs < len(solid))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(solid & before)
    return Words(starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, p.offs))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order, disjoint, and may be empty."""
    out = np.zeros(len(starts), np.uint64)
    lens = ends - starts
    full = np.flatnonzero(lens > 0)
    if full.size:
        lens = lens[full]
        first = np.cumsum(lens) - lens
        pos = np.arange(lens.sum()) - np.repeat(first, lens)
        taken = buf[np.repeat(starts[full], lens) + pos].astype(np.uint64) + np.uint64(1)
        out[full] = np.add.reduceat(taken * _POWERS[pos % 1024] + (pos // 1024).astype(np.uint64), first)
    return mix(out + (ends - starts).astype(np.uint64) * _MUL)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters, in UTF-8; as long as `buf`."""
    out = LOWER[buf]
    upper = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    out[upper] += 32
    return out


def folded_hashes(p: Piece, w: Words) -> np.ndarray:
    """A hash of each word's letters and digits in lower case; other bytes do not count."""
    keep = ALNUM[p.buf]
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(fold(p.buf)[keep], at[w.starts], at[w.ends])


def mean_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of each text's values; nan where it has none."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(bounds)
    return np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), np.nan)


_MARK = np.full(1, 32, np.uint32)
_LETTER = np.array([chr(c).isalpha() for c in range(0x30000)])


def letters(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in lower case, each run of other than letters one space; and each text's bounds.

    A text starts and ends with a space and holds nothing else if it has no letter.
    """
    raw, out, bounds = p.buf.tobytes(), [], [0]
    for s, e in zip(p.offs, p.offs[1:], strict=False):
        points = np.frombuffer(raw[s:e].decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        letter = _LETTER[np.minimum(points, len(_LETTER) - 1)]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        text = np.where(letter, points, 32)[keep]
        out += [_MARK, text, _MARK[: 1 - int(bool(len(text)) and text[-1] == 32)]]
        bounds.append(bounds[-1] + sum(map(len, out[-3:])))
    return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(bounds)
