"""Byte-level BPE: texts to token ids with byte and character offsets, and ids back to bytes and text.

A vocabulary is a file of ranks (base64 bytes and a rank a line). Its bytes become the printable
characters of byte-level vocabularies, a token's merge is the last pair that the ranks themselves
join it from, and the tokenizers library encodes each match of the pattern by them. A match that is
a token is that token. Decoding turns a token's characters back into bytes through the reversed
table and joins them before they are read as UTF-8, so that a character which several tokens share
is whole again.

Texts come in Arrow batches and are encoded in slices. Chunks that no token crosses are encoded
once while a worker remembers them; this changes no id.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from gleaner.llm.common import read_table
from gleaner.llm.tokens import Memo, chunks_of, slices_of

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in set(_PRINTABLE)]
#: Byte to character: printable ones stand for themselves, the others follow from U+0100.
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + n) for n, b in enumerate(_REST)}
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}


def token_chars(token: bytes) -> str:
    return "".join(map(BYTE_CHARS.__getitem__, token))


def token_bytes(chars: str) -> bytes:
    return bytes(map(CHAR_BYTES.__getitem__, chars))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that `token` is joined from when its bytes are merged by rank, leftmost first; None if they never meet."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1))
        if rank > len(ranks):
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts)


class Codec:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are Spark's to deal
        ranks = read_ranks(path)
        pairs = [last_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        merges = [(token_chars(a), token_chars(b)) for a, b in filter(None, pairs)]
        self._library = Tokenizer(models.BPE(vocab={token_chars(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self._library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._pattern = regex.compile(pattern)
        self.table = [b""] * (max(ranks.values()) + 1)
        for chars, token in self._library.get_vocab().items():
            self.table[token] = token_bytes(chars)
        self.decimal = [str(i) for i in range(len(self.table))]
        self.lengths = np.array([len(t) for t in self.table], np.int64)
        self._matches, self._chunks = Memo(self._encode_matches), Memo(self._encode_chunks)

    def _encode_matches(self, matches: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self._library.encode_batch_fast(matches, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        matches = list(map(self._pattern.findall, chunks))
        known = self._matches.of(matches).__getitem__
        return [known(ms[0]) if len(ms) == 1 else b"".join(map(known, ms)) for ms in matches]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [chunks_of(t) if t else [] for t in texts]
        known = self._chunks.of(cut).__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), np.int32) for chunks in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def spans(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end byte, first character, character after the last) of each token. A token that holds a part of a character spans the whole of it."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        char_of = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # from 1: the character of each byte
        return (ends, char_of[starts] - 1, char_of[ends - 1]) if len(ids) else (ends, ends, ends)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One of each kind a worker."""
    return Codec(path, pattern)


def _mapped(docs: DataFrame, kind: str, rows: object) -> DataFrame:
    """(doc_id, ...) of `rows(texts)`, a list of tuples as `kind` says, over slices of each batch."""
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices_of(batch.column("data")):
                columns = zip(*rows(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *[pa.array(c) for c in columns]], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kind}")


def encoded(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...): (doc_id, ids, byte_ends, char_starts, char_ends).

    Arrays of a value a token: its id; the byte of the text where it ends (it starts where the one
    before ends); the first character that it holds a byte of, and the character after the last.

    Null and empty texts: empty arrays. What is not UTF-8 is read as U+FFFD. Strings of special
    tokens are text like any. Rows that repeat come as often; a null doc_id stays. Empty input: no
    rows. Other columns are not looked at.
    """

    def rows(texts: list[str]) -> list[tuple]:
        c = codec(path, pattern)
        return [(ids, *c.spans(ids, t.encode())) for t, ids in zip(texts, c.encode(texts), strict=True)]

    return _mapped(docs, "ids array<int>, byte_ends array<long>, char_starts array<long>, char_ends array<long>", rows)


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """tokens (doc_id, ids) -> (doc_id, data binary, text): the bytes of the ids, and these read as UTF-8.

    Null ids (the array or one in it) give no byte. Ids that cut a character leave U+FFFD in `text`
    and its true bytes in `data`. An id that the vocabulary does not have is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, PATTERN)
        for batch in batches:
            data = [c.decode(i for i in ids.as_py() or () if i is not None) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], names=["doc_id", "data", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, data binary, text string")


def digests(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: what `encoded` and then `decoded` give, without leaving the worker."""
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def rows(texts: list[str]) -> list[tuple]:
        c = codec(path, pattern)
        found = [ids.tolist() for ids in c.encode(texts)]
        return [(len(ids), sha(",".join(map(c.decimal.__getitem__, ids)).encode()), sha(c.decode(ids))) for ids in found]

    return _mapped(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
