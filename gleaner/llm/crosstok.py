"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers read the same bytes: a space and the text. All tokens of both are sorted by their
first byte; a running maximum of their ends tells where a token starts at or after everything
before it has ended, and there one group ends and the next begins. Within a group, each token of A
meets the tokens of B that it overlaps.

A is byte-level (tokenizers library), B marks a space at the start of a piece and falls back to
bytes (sentencepiece). Where neither can have a token across, texts are cut into chunks; a chunk's
tokens, groups and overlaps are found once while a worker remembers it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.bytebpe import token_bytes
from gleaner.llm.common import read_table, stored
from gleaner.llm.tokens import Memo, chunks_of, slices_of

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


#: Chunks of a turn of a worker's memory: each holds more than a chunk of one tokenizer.
CHUNKS = 3 << 16
#: Rows of links that are summed together.
ROWS = 256


class Chunk(NamedTuple):
    """Of one chunk, as bytes of 32-bit integers: its numbers of A tokens, B tokens and groups; id pairs that end together, as a * (size of B) + b. `text`: its groups."""

    counts: bytes
    links: bytes
    text: str


class Whole(NamedTuple):
    """Of one chunk, as bytes of 32-bit integers: numbers as above; ids; tokens of each group; overlapping pairs, by place in the chunk."""

    counts: bytes
    a: bytes
    b: bytes
    a_sizes: bytes
    b_sizes: bytes
    left: bytes
    right: bytes


def coalesced(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group, from 0, of each interval: groups break where a start reaches the running maximum of the ends before."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order = np.lexsort((side, starts))
    top = np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([0], np.cumsum(starts[order][1:] >= top[:-1])))
    groups = np.empty(len(starts), np.int64)
    groups[order] = fresh
    return groups


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all (A, B) that share a byte; each side sorted and without overlaps of its own. At most as many as tokens."""
    first = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_starts, a_ends, "left") - first
    left = np.repeat(np.arange(len(n)), n)
    return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _cut(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """32-bit bytes of each run of `counts` values."""
    data, ends = flat.astype(np.int32).tobytes(), [0, *np.cumsum(counts).tolist()]
    return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]


class Aligner:
    """Two tokenizers and what is known of chunks."""

    def __init__(self, a_path: str = A_PATH, b_path: str = B_PATH) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are Spark's to deal
        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        vocab = self._a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self._a.get_vocab_size()
        for chars, i in vocab.items():
            self.a_bytes[i] = token_bytes(chars)
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        byte = {i: bytes([int(_BYTE.fullmatch(p)[1], 16)]) for i, p in enumerate(pieces) if self._b.is_byte(i)}
        self.b_bytes = [byte.get(i, p.replace(_SPACE, " ").encode()) for i, p in enumerate(pieces)]
        # A piece with a space behind another character would cross the cuts: then a text is one chunk.
        self._whole = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self._space = self._b.piece_to_id(_SPACE)
        lengths = lambda table: np.array([len(t) for t in table], np.int64)
        self._a_lengths, self._b_lengths = lengths(self.a_bytes), lengths(self.b_bytes)
        self.base = len(self.b_bytes)
        #: Each id with what may follow it: within a side, after A's side, after a group, after a chunk.
        self._decimal = [f"{i}{end}" for i in range(max(len(self.a_bytes), self.base)) for end in ",|;\n"]
        self._memo = [Memo(partial(self._learn, whole=w), CHUNKS) for w in (False, True)]

    def pair_bound(self) -> int:
        """How many pairs of ids can end together at all: the shorter one's bytes end the longer's."""
        a, b = (Counter(filter(None, table)) for table in (self.a_bytes, self.b_bytes))
        suffixes = lambda long, short, k0: sum(n * short[t[k:]] for t, n in long.items() for k in range(k0, len(t)))
        return suffixes(a, b, 0) + suffixes(b, a, 1)

    def _learn(self, chunks: list[str], whole: bool) -> list[Chunk | Whole | None]:
        found_a = [e.ids for e in self._a.encode_batch_fast(chunks, add_special_tokens=False)]
        # Each chunk starts with a space, which B adds by itself; it adds none to nothing.
        found_b = self._b.encode([c[1:] for c in chunks], num_threads=1)
        if " " in chunks:
            found_b[chunks.index(" ")] = [self._space]
        data = [c.encode() for c in chunks]
        if (found := self._aligned(found_a, found_b, data, whole)) is not None:
            return found
        bytes_of = lambda table, ids: b"".join(map(table.__getitem__, ids))
        right = [bytes_of(self.a_bytes, a) == bytes_of(self.b_bytes, b) == d for a, b, d in zip(found_a, found_b, data, strict=True)]
        kept = lambda each: [x for x, ok in zip(each, right, strict=True) if ok]
        known = iter(self._aligned(kept(found_a), kept(found_b), kept(data), whole))
        return [next(known) if ok else None for ok in right]

    def _aligned(self, each_a: list[list[int]], each_b: list[list[int]], data: list[bytes], whole: bool) -> list[Chunk | Whole] | None:
        """Chunks laid end to end on one line of bytes: no group crosses their ends. None if the tokens of one have other bytes than `data`."""
        if not data:
            return []
        flat = lambda each: list(chain.from_iterable(each))
        sizes = lambda each: np.fromiter(map(len, each), np.int64, len(each))
        a_list, b_list, n_a, n_b, n_bytes = flat(each_a), flat(each_b), sizes(each_a), sizes(each_b), sizes(data)
        a, b = np.array(a_list, np.int64), np.array(b_list, np.int64)
        if not n_a.all() or not n_b.all() or not b"".join(data) == b"".join(map(self.a_bytes.__getitem__, a_list)) == b"".join(map(self.b_bytes.__getitem__, b_list)):
            return None
        a_ends, b_ends, cuts = np.cumsum(self._a_lengths[a]), np.cumsum(self._b_lengths[b]), np.cumsum(n_bytes)
        if (a_ends[np.cumsum(n_a) - 1] != cuts).any() or (b_ends[np.cumsum(n_b) - 1] != cuts).any():
            return None
        a_starts, b_starts = a_ends - self._a_lengths[a], b_ends - self._b_lengths[b]
        groups = coalesced(np.concatenate((a_starts, b_starts)), np.concatenate((a_ends, b_ends)), np.repeat([0, 1], [len(a), len(b)]))
        a_sizes, b_sizes = np.bincount(groups[: len(a)]), np.bincount(groups[len(a) :])
        n_groups = np.diff(np.append(groups[: len(a)][np.cumsum(n_a) - n_a], len(a_sizes)))
        left, right = overlaps(a_starts, a_ends, b_starts, b_ends)
        chunk_of = np.repeat(np.arange(len(n_a)), n_a)[left]
        counts = _cut(np.stack((n_a, n_b, n_groups), axis=1).ravel(), np.full(len(n_a), 3))
        if whole:
            n_pairs = np.bincount(chunk_of, minlength=len(n_a))
            lefts, rights = _cut(left - (np.cumsum(n_a) - n_a)[chunk_of], n_pairs), _cut(right - (np.cumsum(n_b) - n_b)[chunk_of], n_pairs)
            return list(map(Whole, counts, _cut(a, n_a), _cut(b, n_b), _cut(a_sizes, n_groups), _cut(b_sizes, n_groups), lefts, rights))
        meet = a_ends[left] == b_ends[right]
        links = _cut(a[left[meet]] * self.base + b[right[meet]], np.bincount(chunk_of[meet], minlength=len(n_a)))
        return list(map(Chunk, counts, links, self._texts(a, b, a_sizes, b_sizes, n_groups)))

    def _texts(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each chunk: ids with what follows them, in their places, joined once for all chunks."""
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        words = np.empty(len(a) + len(b), np.int64)
        places_a = np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)
        places_b = np.arange(len(b)) + np.repeat(a_ends, b_sizes)
        words[places_a], words[places_b] = 4 * a, 4 * b
        words[places_a[a_ends - 1]] += 1
        words[places_b[b_ends - 1]] += 2
        words[places_b[b_ends[np.cumsum(n_groups) - 1] - 1]] += 1
        return "".join(map(self._decimal.__getitem__, words.tolist())).split("\n")[:-1]

    def align(self, texts: list[str], whole: bool = False) -> list[list[Chunk] | list[Whole]]:
        """The chunks of each text; none if it has no tokens. `whole`: with ids, sizes and overlaps instead of links and text."""
        cut = []
        for t in texts:
            chunks = [t] if t and self._whole else chunks_of(t) if t else []
            cut.append([" " + chunks[0], *chunks[1:]] if chunks else [])
        known = self._memo[whole].of(cut).__getitem__
        found = [list(map(known, chunks)) for chunks in cut]
        return [[] if None in chunks else chunks for chunks in found]


@lru_cache(maxsize=4)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One of each kind a worker."""
    return Aligner(a_path, b_path)


def _mapped(docs: DataFrame, kinds: str, row: Callable[[list], tuple], whole: bool, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, ...) of `row(chunks)` for each text."""
    names = [c.split()[0] for c in kinds.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for first, texts in slices_of(batch.column("data")):
                columns = zip(*map(row, own.align(texts, whole)), strict=True)
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *arrays], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")


def _joined(parts: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int32)


def _shifted(parts: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
    """Places within chunks as places within the text."""
    return (_joined(parts) + np.repeat(np.cumsum(counts) - counts, [len(p) // 4 for p in parts])).astype(np.int32)


def alignments(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): (doc_id, a_ids, b_ids, a_sizes, b_sizes, a_at, b_at).

    a_ids, b_ids: tokens of a space and the text by A, of the text by B, which adds the space.
    a_sizes, b_sizes: how many tokens of each side the groups have, in order. a_at, b_at: places
    (from 0) of each pair of tokens that overlap.

    Null and empty texts, and texts whose joined bytes of A or B are not those of space and text,
    have empty arrays. What is not UTF-8 is read as U+FFFD. Strings of special tokens are text like
    any. Rows that repeat come as often; a null doc_id stays. Empty input: no rows. Other columns
    are not looked at.
    """

    def row(chunks: list[Whole]) -> tuple:
        fields = list(zip(*chunks, strict=True)) or [()] * 7
        counts = _joined(fields[0]).reshape(-1, 3)
        return *map(_joined, fields[1:5]), _shifted(fields[5], counts[:, 0]), _shifted(fields[6], counts[:, 1])

    return _mapped(docs, ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_sizes", "b_sizes", "a_at", "b_at")), row, True, a_path, b_path)


def _linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): `links` are id pairs that end together, as a * (size of B) + b."""

    def row(chunks: list[Chunk]) -> tuple:
        counts, links, texts = zip(*chunks, strict=True) if chunks else ((), (), ())
        digest = hashlib.sha256(";".join(texts).encode()).hexdigest() if chunks else ""
        return *_joined(counts).reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist(), digest, _joined(links)

    return _mapped(docs, "n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>", row, False, a_path, b_path)


def digests(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of `docs`.

    Counts of linked id pairs are over all rows. Two tokens end together only if one's bytes end
    the other's, so the table of counts is bounded by the vocabularies, whatever the input; it is
    checked against that bound, and travels to the tasks.
    """
    spark = docs.sparkSession
    own = aligner(a_path, b_path)
    if len(own.a_bytes) * own.base >= 1 << 31:
        raise ValueError("these vocabularies' pairs do not fit 32 bits")
    rows = stored(_linked(docs, a_path, b_path))
    counts = rows.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).toArrow()
    if counts.num_rows > own.pair_bound():
        raise RuntimeError("more pairs than the vocabularies allow")
    pairs, n = counts["pair"].to_numpy().astype(np.int64), counts["n"].to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    most = np.zeros(own.base, np.int64)
    np.maximum.at(most, pairs % own.base, n)
    table = spark.sparkContext.broadcast((pairs.astype(np.int32), n, n == most[pairs % own.base]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            links = batch.column("links")
            sizes = links.value_lengths().to_numpy()
            at = np.searchsorted(known, links.flatten().to_numpy(zero_copy_only=False))
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros(len(sizes), np.int64)
            np.add.at(sums, row_of, count[at])
            n_best = np.bincount(row_of[best[at]], minlength=len(sizes)).astype(np.int64)
            new = [pa.array(sizes.astype(np.int64)), pa.array(n_best), pa.array(sums)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], *new, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(run, kinds)


def op11_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
