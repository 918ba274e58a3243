"""Language ID by language-bitmask n-gram filters.

Each language has a Bloom filter of all character n-grams of its teaching rows. The filters are
bit-sliced: slot j of the table holds one bit for each language, so that one lookup, the AND of a
gram's HASHES slots, returns all languages that have the gram. A text's languages are decided by
popcounts: per language, the grams found less those expected by false positives, which the filter's
fill tells.

Tasks turn the distinct grams into bits of slots, and bits of a slot are joined before they are
collected: what comes to the driver is the table, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bytescan
from gleaner.llm.common import read_table, stored
from gleaner.llm.toxicity import fold_of

SIZES = (1, 2, 3, 4)
SLOTS = 1 << 22
HASHES = 4
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_FLUSH = 1 << 22


def _grams(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each gram, the text it is in), for each size; grams lie within a text and hold a space at their ends only."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    space = points == 32
    h = bytescan.mix(points.astype(np.uint64))
    inner = np.zeros(len(points), bool)  # a space inside the gram so far
    for n in range(1, max(SIZES) + 1):
        k = len(points) - n + 1
        if k <= 0:
            return
        if n > 1:
            h = bytescan.follow(h[:k], points[n - 1 :].astype(np.uint64))
            inner = inner[:k] | (space[n - 2 : n - 2 + k] if n > 2 else False)
        if n in SIZES:
            fine = (text[:k] == text[n - 1 :]) & ~inner[:k]
            if n == 1:
                fine &= ~space
            elif n == 2:
                fine &= ~(space[:k] & space[1:])
            at = np.flatnonzero(fine)
            yield h[at], text[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each gram by language, summed over a partition piece by piece."""
    held: dict[str, list[np.ndarray]] = {}

    def counted(lang: str) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for p in bytescan.pieces(batch.column("text")):
            points, bounds = bytescan.letters(p)
            own = langs[p.first : p.first + p.rows]
            for grams, text in _grams(points, bounds):
                for lang in set(own):
                    held.setdefault(lang, []).append(grams[(own == lang)[text]])
            for lang in [x for x, parts in held.items() if sum(map(len, parts)) > _FLUSH]:
                yield counted(lang)
    for lang in list(held):
        yield counted(lang)


def gram_counts(taught: DataFrame) -> DataFrame:
    """taught (text, lang) -> (lang, gram, n)."""
    return taught.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # [SLOTS, bytes of 8 languages]
    false: np.ndarray  # of each language: chance that a gram it does not have is found
    fallback: str


def _slots(grams: np.ndarray) -> Iterator[np.ndarray]:
    step = bytescan.mix(grams) | np.uint64(1)
    for k in range(HASHES):
        yield ((grams + np.uint64(k) * step) % np.uint64(SLOTS)).astype(np.int64)


def _bits(langs: list[str]):
    """(lang, gram) -> (slot, byte, bits): the bits that a task's grams set, each slot and byte once."""
    place = {lang: k for k, lang in enumerate(langs)}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SLOTS, -(-len(langs) // 8)), np.uint8)
        for batch in batches:
            k = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for slots in _slots(batch.column("gram").to_numpy().view(np.uint64)):
                np.bitwise_or.at(table, (slots, k // 8), np.uint8(1) << (k % 8).astype(np.uint8))
        slots, words = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(table[slots, words].astype(np.int16))], names=["slot", "byte", "bits"])

    return bits


def fit(taught: DataFrame) -> Filters:
    """Build the filters; `fallback` is the language with the most grams, for texts in which no gram is known."""
    counts = stored(gram_counts(taught))
    rows = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()  # one a language
    langs = [r["lang"] for r in rows]
    table = np.zeros((SLOTS, max(1, -(-len(langs) // 8))), np.uint8)
    if langs:
        set_bits = counts.select("lang", "gram").mapInArrow(_bits(langs), "slot int, byte int, bits short").groupBy("slot", "byte").agg(F.bit_or("bits").alias("bits")).toArrow()
        table[set_bits.column("slot").to_numpy(), set_bits.column("byte").to_numpy()] = set_bits.column("bits").to_numpy()
    false = np.array([((table[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)).mean() ** HASHES for k in range(len(langs))])
    return Filters(langs, table, false, max(rows, key=lambda r: (r["n"], r["lang"]))["lang"] if rows else UNKNOWN)


def decide(f: Filters, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the winner's share of all languages' corrected popcounts."""
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if not f.langs:
        return names.tolist(), scores
    for p in bytescan.pieces(texts):
        points, bounds = bytescan.letters(p)
        hits, total = np.zeros((p.rows, len(f.langs))), np.zeros(p.rows)
        for grams, text in _grams(points, bounds):
            mask = None
            for slots in _slots(grams):
                mask = f.table[slots] if mask is None else mask & f.table[slots]
            total += np.bincount(text, minlength=p.rows)
            for k in range(len(f.langs)):
                hits[:, k] += np.bincount(text, weights=(mask[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1), minlength=p.rows)
        true = np.maximum(hits - total[:, None] * f.false, 0) / (1 - f.false)
        best, mass = true.argmax(axis=1), true.sum(axis=1)
        some = total > 0
        at = slice(p.first, p.first + p.rows)
        names[at] = np.where(some, np.where(mass > 0, np.array(f.langs, object)[best], f.fallback), UNKNOWN)
        scores[at] = np.where(some & (mass > 0), true.max(axis=1) / np.maximum(mass, 1e-9), 0.0)
    return names.tolist(), np.clip(scores, 0, 1)


def language(docs: DataFrame, taught: DataFrame) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, ...).

    `taught` (text, lang): rows with a null lang or text teach nothing. Text that is null or has no
    letter: `und`, score 0. Letters but no known gram: the language with the most grams, score 0. A
    tie goes to the first language in order of name. Nothing taught: `und` throughout. A null
    doc_id is judged and not held out. Rows that repeat are judged alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(taught.where("lang is not null and text is not null")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = decide(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.fill_null(batch.column("held_out"), False), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    ids = docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return ids.mapInArrow(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language(docs, docs.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("text", "lang"))
