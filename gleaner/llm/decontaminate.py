"""Benchmark decontamination by template canonicalisation.

Words keep their letters and digits, in lower case; numbers, names and units become typed
placeholders. Windows of five such words are hashed and joined between benchmark items and
documents, so that a question with other numbers or names is met in the same windows. A window also
has the hash of its literal words, for copies in other case, and one in which capitalised words that
open a sentence are names too; any of them finds it. A document
holds an item if it has at least 0.8 of the item's windows and if the slots agree: within one
alignment the same value of the item always stands for the same value of the document, and the
other way round, for at least 0.8 of the slots. An unchanged passage agrees with itself.

Documents are scanned once, as bytes; only windows that pass a bit table of fixed size, which the
benchmark's windows set, are emitted and hash-joined. The table only saves rows: the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import bytescan
from gleaner.llm.common import as_row, columns_of, read_table, small_or_not, stored

WINDOW = 5
COVERAGE = 0.8
CONSISTENCY = 0.8
#: A window with fewer words that are not placeholders is compared by its literal words.
LEAST_LITERAL = 2
TABLE_BITS = 1 << 23
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams lb lbs pound pounds ton tons ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur "
    "percent degree degrees watt watts volt volts meter meters metre metres"
).split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:"]] = True
_NUMBER, _NAME, _UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


def _hashes_of(words: list[str]) -> np.ndarray:
    p = next(bytescan.pieces(pa.array([" ".join(words)])))
    return bytescan.folded_hashes(p, bytescan.words(p))


_UNIT_HASHES = np.sort(_hashes_of(UNITS))


def templates(p: bytescan.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template word, the same with names that open sentences, literal word, bounds of each text) as hashes; a template word under 4 is a placeholder."""
    w = bytescan.words(p)
    keep = bytescan.ALNUM[p.buf]
    at = np.concatenate([[0], np.cumsum(keep)])
    starts, ends = at[w.starts], at[w.ends]
    solid = ends > starts
    literal = bytescan.span_hashes(bytescan.fold(p.buf)[keep], starts, ends)[solid]
    bounds = np.concatenate([[0], np.cumsum(solid)])[w.bounds]
    if not len(literal):
        return literal, literal, literal, bounds
    flat = p.buf[keep]
    first = flat[starts[solid]]
    second = flat[np.minimum(starts[solid] + 1, len(flat) - 1)]
    # A sentence starts with a text, after a line end, or after a word that ends one.
    lines = np.concatenate([[0], np.cumsum(p.buf == 10)])
    opens = np.ones(len(w.starts), bool)
    opens[1:] = _ENDS[p.buf[w.ends[:-1] - 1]] | (lines[w.starts[1:]] > lines[w.ends[:-1]])
    opens[w.bounds[:-1][w.bounds[:-1] < len(opens)]] = True
    number = _DIGIT[first]
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = upper & ~number & ((ends - starts)[solid] > 1 + (first >= 0x80))
    after = np.zeros(len(number), bool)
    after[1:] = number[:-1]
    after[bounds[:-1][bounds[:-1] < len(after)]] = False
    unit = after & ~number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, literal), len(_UNIT_HASHES) - 1)] == literal)
    literal = literal | np.uint64(4)
    template, wide = (np.select([number, unit, x], [_NUMBER, _UNIT, _NAME], literal) for x in (name & ~opens[solid], name))
    return template, wide, literal, bounds


def _chain(words: np.ndarray) -> np.ndarray:
    """Hash of each run of WINDOW words."""
    n = len(words) - WINDOW + 1
    h = bytescan.mix(words[:n])
    for k in range(1, WINDOW):
        h = bytescan.follow(h, words[k : k + n])
    return h


def windows(p: bytescan.Piece) -> tuple[np.ndarray, ...]:
    """(own, hash, kind, text, position in the text, start, words, template, wide, literal): one row a window and kind of hash; a shorter text is one window.

    `own` is the hash of kind 0 of the same window: of template words, or of literal ones if few are
    not placeholders. Kind 1 is of `wide`, where names may open sentences; kind 2 of literal words.
    Both only where they differ. `start` and `words` say where a window lies in the last three,
    which are the words of all texts.
    """
    template, wide, literal, bounds = templates(p)
    pad = np.zeros(WINDOW, np.uint64)
    template, wide, literal = (np.concatenate([x, pad]) for x in (template, wide, literal))
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(text)) - np.repeat(bounds[:-1], n)
    room = np.repeat(n, n) - pos
    take = np.flatnonzero((room >= WINDOW) | (pos == 0))
    size = np.minimum(room[take], WINDOW)
    short = np.flatnonzero(size < WINDOW)

    def hashes(words: np.ndarray) -> np.ndarray:
        h = _chain(words)[take]
        for i in short:
            h[i] = _chain(np.concatenate([words[take[i] : take[i] + size[i]], pad[: WINDOW - size[i]]]))[0]
        return h

    def n_where(flags: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(flags)])
        return at[take + size] - at[take]

    as_literal = hashes(literal)
    own = np.where(n_where(template > 3) < LEAST_LITERAL, as_literal, hashes(template))
    opened = np.flatnonzero((n_where(wide != template) > 0) & (n_where(wide > 3) >= LEAST_LITERAL))
    plain = np.flatnonzero(own != as_literal)
    rows = np.concatenate([np.arange(len(take)), opened, plain])
    kind = np.repeat([0, 1, 2], [len(take), len(opened), len(plain)])
    h = np.concatenate([own, hashes(wide)[opened] if opened.size else own[:0], as_literal[plain]])
    return own[rows], h, kind, text[take][rows], pos[take][rows], take[rows], size[rows], template, wide, literal


def _scan(table: np.ndarray | None):
    """Rows (id, k, own, h, kind, pos, template, literal) of all windows, or of those that `table` may hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in bytescan.pieces(batch.column("text")):
                own_h, h, kind, text, pos, at, size, template, wide, literal = windows(p)
                hit = np.flatnonzero(table[(h % np.uint64(TABLE_BITS)).astype(np.int64)]) if table is not None else np.arange(len(h))
                if not hit.size:
                    continue
                rows = pa.array(p.first + text[hit])
                cells = at[hit][:, None] + np.arange(WINDOW)
                own = np.arange(WINDOW) < size[hit][:, None]
                ends = pa.array(np.arange(0, WINDOW * len(hit) + 1, WINDOW, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.where(own, x, 0).view(np.int64).ravel())) for x in (np.where(kind[hit][:, None] == 1, wide[cells], template[cells]), literal[cells])]
                columns = [batch.column("id").take(rows), batch.column("k").take(rows), pa.array(own_h[hit].view(np.int64)), pa.array(h[hit].view(np.int64)), pa.array(kind[hit].astype(np.int64)), pa.array(pos[hit].astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "own", "h", "kind", "pos", "template", "literal"])

    return scan


def _windows_of(df: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """df (id, k, text) -> its windows; `k`, a hash of the text, tells apart texts that share an id."""
    return df.mapInArrow(_scan(table), f"id {dict(df.dtypes)['id']}, k long, own long, h long, kind long, pos long, template array<long>, literal array<long>")


def _held(held):
    """`_scan` with the table of a broadcast."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(held.value)(batches)

    return scan


def _agreement(slots: DataFrame, this: str, other: str) -> DataFrame:
    """How many slots go with the most frequent `other` value of their `this` value, per document, item and alignment."""
    run = ["mode", "id", "k", "item_id", "shift"]
    return slots.groupBy(*run, this, other).agg(F.count(F.lit(1)).alias("n")).groupBy(*run, this).agg(F.max("n").alias("n")).groupBy("mode", "id", "k", "item_id").agg(F.sum("n").alias(f"by_{this}"))


def _covered(found: DataFrame, asked: DataFrame, sizes: DataFrame, modes: Column, coverage: float) -> DataFrame:
    """(mode, id, k, item_id, n_found, n_windows) of documents that hold `coverage` of an item's windows; no places, no repeats.

    An item of n windows that is covered has one of any n - ceil(coverage * n) + 1 of them in the
    document. Those that the fewest items have are the keys of the join: windows that many items
    share bring no pair together. The pairs are then counted over all windows.
    """
    seen = stored(found.select("id", "k", "kind", "h").distinct())
    own = asked.select("item_id", "own").distinct()
    spread = own.groupBy("own").agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "own"))
    keys = own.join(spread, "own").withColumn("rank", rank).join(sizes, "item_id").where(F.col("rank") <= F.col("n_windows") - F.ceil(coverage * F.col("n_windows")) + 1)
    keys = asked.select("item_id", "own", "h").distinct().join(keys.select("item_id", "own"), ["item_id", "own"], "left_semi").select("item_id", "h").distinct()
    some = stored(seen.select("id", "k", "h").distinct().join(small_or_not(keys, 40), "h").select("id", "k", "item_id").distinct())
    kinds = asked.select("item_id", "own", "h", "item_kind").distinct()
    here = seen.withColumnsRenamed({"id": "_id", "k": "_k", "h": "_h"})
    met = some.join(small_or_not(kinds, 60), "item_id").join(here, F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")))
    counted = met.withColumn("mode", F.explode(modes)).groupBy("mode", "id", "k", "item_id").agg(F.countDistinct("own").alias("n_found"))
    return counted.join(small_or_not(sizes, 40), "item_id").where(F.col("n_found") >= coverage * F.col("n_windows")).select("mode", "id", "k", "item_id", "n_found", "n_windows")


def matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row (id, k, item_id, n_windows, n_found, n_slots, agreement) for each document and benchmark item that it holds.

    docs (id, k, text), items (item_id, text). n_windows: distinct windows of the item, n_found: of
    these in the document, n_slots: placeholders met, agreement: share of them that agree (no
    slots: 1). Texts without a word, or null, hold nothing and are held nowhere. An item of fewer
    than WINDOW words is held only by a document of the same words. Items that share an id are
    one item; items with a null id are left out. Documents that repeat give one row.
    """
    spark = docs.sparkSession
    asked = _windows_of(items.where("item_id is not null").select(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("k"), "text")).select(
        F.col("id").alias("item_id"), "own", "h", F.col("kind").alias("item_kind"), F.col("pos").alias("item_pos"), F.col("template").alias("item_template"), F.col("literal").alias("item_literal")
    )
    asked = stored(asked)
    table = np.zeros(TABLE_BITS, bool)
    table[asked.select(F.expr(f"cast(pmod(h, {TABLE_BITS}L) as int)").alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    sizes = asked.groupBy("item_id").agg(F.countDistinct("own").alias("n_windows"))
    held = spark.sparkContext.broadcast(table)
    found = stored(docs.mapInArrow(_held(held), f"id {dict(docs.dtypes)['id']}, k long, own long, h long, kind long, pos long, template array<long>, literal array<long>"))
    # Names that open sentences are optional: an item is held if it is without them (mode 0) or with them (mode 1).
    modes = F.when((F.col("item_kind") == 1) | (F.col("kind") == 1), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    pairs = stored(_covered(found, asked, sizes, modes, coverage))
    # Places are looked at for pairs that pass only.
    asked_pairs = pairs.select("mode", "id", "k", "item_id").join(small_or_not(asked, 200), "item_id")
    here = found.drop("own").withColumnsRenamed({"id": "_id", "k": "_k", "h": "_h"})
    met = asked_pairs.join(here, F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h"))).where(F.array_contains(modes, F.col("mode")))
    # Two windows that meet by several kinds of hash are one hit, by the first kind.
    first = F.min(F.struct((F.col("item_kind") + F.col("kind")).alias("kinds"), "own", "item_template", "item_literal", "template", "literal")).alias("_hit")
    hits = met.groupBy("mode", "id", "k", "item_id", "pos", "item_pos").agg(first).select("mode", "id", "k", "item_id", "pos", "item_pos", "_hit.*")
    slots = hits.select(
        "mode", "id", "k", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.inline(F.expr("filter(arrays_zip(item_template, item_literal, template, literal), x -> x.item_template between 1 and 3 and x.template = x.item_template)")),
    ).select("mode", "id", "k", "item_id", "shift", F.col("item_literal").alias("item_value"), F.col("literal").alias("value"))
    total = slots.groupBy("mode", "id", "k", "item_id").agg(F.count(F.lit(1)).alias("n_slots"))
    agreed = total.join(_agreement(slots, "item_value", "value"), ["mode", "id", "k", "item_id"]).join(_agreement(slots, "value", "item_value"), ["mode", "id", "k", "item_id"])
    agreed = agreed.select(*[F.col(c).alias(f"_{c}") for c in ("mode", "id", "k", "item_id")], "n_slots", (F.least("by_item_value", "by_value") / F.col("n_slots")).alias("agreement"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k")) & (F.col("item_id") == F.col("_item_id")) & (F.col("mode") == F.col("_mode"))
    out = pairs.join(agreed, same, "left").select("mode", "id", "k", "item_id", "n_windows", "n_found", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"))
    shown = ["n_windows", "n_found", "n_slots", "agreement"]
    best = F.max_by(F.struct(*shown), F.struct("n_found", "agreement", -F.col("mode"))).alias("_best")
    return out.where(F.col("agreement") >= consistency).groupBy("id", "k", "item_id").agg(best).select("id", "k", "item_id", "_best.*")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("k"), "text")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`matches` of `docs` (doc_id, text, ...), with doc_id: see there for nulls and repeats. Other columns are not looked at."""
    return matches(_keyed(docs), items).select(F.col("id").alias("doc_id"), "item_id", "n_windows", "n_found", "n_slots", "agreement")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with their own columns; rows that repeat stay repeated."""
    bad = matches(_keyed(docs), items).select(F.col("id").alias("_id"), F.col("k").alias("_bad")).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), as_row(docs))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_bad")), "left_anti").select(*columns_of("row", docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
