"""Toxicity by class-conditional Kneser-Ney models.

For each class, an interpolated Kneser-Ney model of the letters of words: a letter given the up to
ORDER - 1 before it in its word. So an expression is known by its stem, whatever its ending, and one
that no text had before by its parts. Counts of the highest order are occurrences, those below
numbers of contexts, and each order's discount follows from its counts of counts. From SHARED
letters down, both classes back off to the same counts: where a class has seen too little, it
speaks for neither. A text's evidence is the difference of its toxic and ordinary log-likelihoods
over its length in letters and word ends, turned into a probability by a logistic curve, which is
fitted on a histogram of rows that the counts did not see.

A gram is a long of up to four code points (16 bits each; beyond those, folded into them), so its
context and its suffix are a shift and a mask, and the model is made by joins. Scoring sends the
model to the tasks while its counted size is below MODEL_BYTES, and joins it by a shuffle beyond.

`tests/llm/tune_toxicity.py` shows how ORDER and SHARED were chosen: on rows that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleaner.llm import bytescan
from gleaner.llm.common import read_table, small_or_not, stored

ORDER, SHARED = 4, 2
#: For an order whose counts of counts tell nothing.
DISCOUNT = 0.75
MODEL_BYTES = 64 << 20
FOLDS = 5
#: Of the rows that are not held out (crc32 of the id modulo FOLDS not 0), those with this remainder modulo CURVE_FOLDS fit the curve; the rest are counted.
CURVE_FOLDS, CURVE_FOLD = 10, 9
_FLUSH = 1 << 21
_BINS = 1000


def text_grams(p: bytescan.Piece, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text it is in) of each letter and word end of a piece; a gram reaches back to its word's start at most."""
    points, bounds = bytescan.letters(p)
    unit = np.where(points > 0xFFFF, (points & 0xFFFF) | 0x8000, points).astype(np.uint64)
    text = np.repeat(np.arange(p.rows), np.diff(bounds))
    gram, open_ = unit.copy(), np.ones(len(unit), bool)
    for back in range(1, order):
        before = np.zeros(len(unit), np.uint64)
        before[back:] = unit[:-back]
        before[~open_] = 0
        gram |= before << np.uint64(16 * back)
        open_ &= before > 32
    asked = np.ones(len(unit), bool)
    asked[bounds[:-1][bounds[:-1] < len(unit)]] = False
    asked[1:] &= (unit[1:] != 32) | (unit[:-1] != 32)
    return gram[asked], text[asked]


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def counted() -> pa.RecordBatch:
            parts = [np.unique(np.concatenate([*h, np.zeros(0, np.uint64)]), return_counts=True) for h in held]
            for h in held:
                h.clear()
            gram = np.concatenate([g for g, _ in parts]).view(np.int64)
            t, o = (np.concatenate([n if k == own else np.zeros(len(g), np.int64) for k, (g, n) in enumerate(parts)]) for own in (1, 0))
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(t.astype(np.int64)), pa.array(o.astype(np.int64))], names=["gram", "t", "o"])

        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for p in bytescan.pieces(batch.column("text")):
                gram, text = text_grams(p, order)
                own = toxic[p.first + text]
                for k in range(2):
                    held[k].append(gram[own == bool(k)])
                if sum(map(len, held[0])) + sum(map(len, held[1])) > _FLUSH:
                    yield counted()
        yield counted()

    return count


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """labelled (text, toxic 0/1) -> (gram, t, o): how often each gram occurs in toxic and in ordinary texts."""
    return labelled.select("text", F.col("toxic").cast("int")).mapInArrow(_counter(order), "gram long, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _longer(symbols: int) -> Column:
    """Whether a gram has more than so many symbols."""
    return F.shiftrightunsigned("gram", 16 * symbols) != 0


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else DISCOUNT


def _level(rows: DataFrame, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """rows (gram, t, o) of one order, lower (suffix, low_t, low_o) -> (gram, pt, po) and (context, weight_t, weight_o), the backoff's weights."""
    n = rows.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "to" for k in (1, 2)], F.count(F.lit(1)).alias("all")).first()
    contexts = rows.groupBy(F.shiftrightunsigned("gram", 16).alias("context")).agg(*[x for c in "to" for x in (F.sum(c).alias(f"all_{c}"), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))])
    d = {c: _discount(n[f"{c}1"], n[f"{c}2"]) for c in "to"}
    weights = contexts.select("context", *[F.col(f"all_{c}") for c in "to"], *[F.when(F.col(f"all_{c}") > 0, d[c] * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0).alias(f"weight_{c}") for c in "to"])
    met = rows.withColumn("context", F.shiftrightunsigned("gram", 16)).join(weights, "context")
    if lower is None:
        met = met.withColumn("low_t", F.lit(1.0 / max(n["all"], 1))).withColumn("low_o", F.col("low_t"))
    else:
        met = met.join(lower, "suffix")
    own = lambda c: F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - d[c], F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0)
    return met.select("gram", *[(own(c) + F.col(f"weight_{c}") * F.col(f"low_{c}")).alias(f"p{c}") for c in "to"]), weights.select("context", "weight_t", "weight_o")


def kneser_ney(counts: DataFrame, order: int = ORDER, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """counts (gram, t, o) -> (gram, value), the log ratio of a gram's two probabilities, and (context, value), of its two backoff weights.

    Only grams of more than `shared` symbols are returned; for the others both are equal.
    """
    suffix = lambda symbols: F.col("gram").bitwiseAND(F.lit((1 << 16 * symbols) - 1))
    levels = {order: counts.where(_longer(order - 1)).select("gram", "t", "o", (F.col("t") + F.col("o")).alias("both"))}
    for n in range(order - 1, 0, -1):
        whole = counts.where(_longer(n - 1) & ~_longer(n)).select("gram", "t", "o", (F.col("t") + F.col("o")).alias("both"))
        seen = levels[n + 1].groupBy(suffix(n).alias("gram")).agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"), F.count(F.lit(1)).alias("both"))
        levels[n] = stored(whole.unionByName(seen) if n > 1 else seen)
    lower, grams, contexts = None, [], []
    for n in range(1, order + 1):
        rows = levels[n] if n > shared else levels[n].select("gram", F.col("both").alias("t"), F.col("both").alias("o"))
        probable, weights = _level(rows.withColumn("suffix", suffix(n - 1)), lower)
        probable = stored(probable)
        lower = probable.select(F.col("gram").alias("suffix"), F.col("pt").alias("low_t"), F.col("po").alias("low_o"))
        if n > shared:
            grams.append(probable.select("gram", F.log(F.col("pt") / F.col("po")).alias("value")))
            contexts.append(weights.select("context", F.log(F.col("weight_t") / F.col("weight_o")).alias("value")))
    return stored(_union(grams)), stored(_union(contexts))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Table:
    """Sorted keys and their values."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether known) of each asked key; 0 where it is not."""
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        known = self.keys[at] == asked
        return np.where(known, self.values[at], 0.0), known


def _table(df: DataFrame) -> Table:
    key, value = (c.to_numpy() for c in df.toArrow().columns)
    order = np.argsort(key.view(np.uint64))
    return Table(key.view(np.uint64)[order], value[order])


@dataclass
class Model:
    grams: DataFrame
    contexts: DataFrame
    order: int
    shared: int
    limit: int = MODEL_BYTES
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0
    trained: bool = False


def log_ratios(gram: np.ndarray, grams: Table, contexts: Table, order: int, shared: int) -> np.ndarray:
    """Log ratio of each gram: of its longest known suffix, and of the backoff weights on the way there."""
    out, left = np.zeros(len(gram)), np.arange(len(gram))
    for n in range(order, shared, -1):
        asked = gram[left]
        value, known = grams.of(asked)
        out[left] += value
        # A gram that has fewer symbols anyway was no gram of this order.
        weight = np.where(known | (asked >> np.uint64(16 * (n - 1)) == 0), 0.0, contexts.of(asked >> np.uint64(16))[0])
        out[left] += weight
        left = left[~known]
        gram = gram & np.uint64((1 << 16 * (n - 1)) - 1)
    return out


def _evidence(texts: pa.Array, grams: Table, contexts: Table, order: int, shared: int) -> np.ndarray:
    """Mean log ratio of each text; nan without a letter."""
    out = np.full(len(texts), np.nan)
    for p in bytescan.pieces(texts):
        gram, text = text_grams(p, order)
        n = np.bincount(text, minlength=p.rows)
        sums = np.bincount(text, weights=log_ratios(gram, grams, contexts, order, shared), minlength=p.rows)
        out[p.first : p.first + p.rows] = np.where(n > 0, sums / np.maximum(n, 1), np.nan)
    return out


def _text_gram_rows(order: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in bytescan.pieces(batch.column("text")):
                gram, text = text_grams(p, order)
                by = np.lexsort([gram, text])
                gram, text = gram[by], text[by]
                new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])) if len(gram) else np.zeros(0, int)
                rows = pa.array(p.first + text[new])
                yield pa.RecordBatch.from_arrays([batch.column("k").take(rows), batch.column("k2").take(rows), pa.array(gram[new].view(np.int64)), pa.array(np.diff(np.append(new, len(gram))))], names=["k", "k2", "gram", "n"])

    return emit


def _evidence_by_joins(df: DataFrame, model: Model) -> DataFrame:
    """As `with_evidence`, for a model of any size: distinct grams of all texts find their values by joins."""
    k, k2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    found = stored(df.select("text", k.alias("k"), k2.alias("k2")).dropDuplicates(["k", "k2"]).mapInArrow(_text_gram_rows(model.order), "k long, k2 long, gram long, n long"))
    zero = F.lit(0.0)
    asked = found.select("gram").distinct().select("gram", F.col("gram").alias("rest"), zero.alias("value"), F.lit(False).alias("known"))
    for n in range(model.order, model.shared, -1):
        longer = F.shiftrightunsigned("rest", 16 * (n - 1)) != 0
        grams = model.grams.select(F.col("gram").alias("rest"), F.col("value").alias("own"))
        contexts = model.contexts.select("context", F.col("value").alias("weight"))
        met = asked.join(grams, "rest", "left").withColumn("context", F.shiftrightunsigned("rest", 16)).join(contexts, "context", "left")
        step = F.when(F.col("known"), zero).when(F.col("own").isNotNull(), F.col("own")).when(longer, F.coalesce("weight", zero)).otherwise(zero)
        asked = met.select("gram", F.col("rest").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1)).alias("rest"), (F.col("value") + step).alias("value"), (F.col("known") | F.col("own").isNotNull()).alias("known"))
    means = found.join(asked.select("gram", "value"), "gram").groupBy("k", "k2").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("evidence"))
    return df.withColumn("_k", k).withColumn("_k2", k2).join(means, (F.col("_k") == F.col("k")) & (F.col("_k2") == F.col("k2")), "left").select(*df.columns, "evidence")


def with_evidence(df: DataFrame, model: Model) -> DataFrame:
    """`df` (text, ...) with `evidence`, the mean log ratio; null for a text without a letter."""
    if 16 * (model.grams.count() + model.contexts.count()) > model.limit:
        return _evidence_by_joins(df, model)
    held = df.sparkSession.sparkContext.broadcast((_table(model.grams), _table(model.contexts), model.order, model.shared))

    @F.arrow_udf(DoubleType())
    def evidence(texts: pa.Array) -> pa.Array:
        found = _evidence(texts, *held.value)
        return pa.array(found, mask=np.isnan(found))

    return df.withColumn("evidence", evidence("text"))


def _logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    mid, scale = np.average(x, weights=ones + zeros), max(1e-6, np.sqrt(np.cov(x, aweights=ones + zeros)) if len(x) > 1 else 1.0)
    z = np.stack([(x - mid) / scale, np.ones_like(x)])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ z, -30, 30)))
        step = np.linalg.solve((z * ((ones + zeros) * p * (1 - p))) @ z.T + 1e-2 * np.eye(2), z @ (ones - (ones + zeros) * p) - 1e-2 * b)
        b = b + np.clip(step, -5, 5)
    return float(b[0] / scale), float(b[1] - b[0] * mid / scale)


def fit(labelled: DataFrame, order: int = ORDER, shared: int = SHARED, limit: int = MODEL_BYTES) -> Model:
    """labelled (text, toxic, curve): rows with `curve` fit the logistic, the others are counted."""
    labelled = labelled.where("toxic in (0, 1)")
    counts = stored(gram_counts(labelled.where("not curve"), order))
    model = Model(*kneser_ney(counts, order, shared), order, shared, limit)
    n = counts.agg(F.sum("t"), F.sum("o")).first()
    model.trained = bool(n[0] and n[1]) and not model.grams.isEmpty()
    curve = labelled.where("curve")
    seen = with_evidence(curve, model) if model.trained else curve.withColumn("evidence", F.lit(None).cast("double"))
    bins = seen.select(F.round(F.col("evidence") * _BINS).alias("bin"), "toxic").groupBy("bin").agg(F.sum("toxic").alias("ones"), F.count(F.lit(1)).alias("n")).toArrow()
    x, ones, n = (bins.column(k).to_numpy().astype(float) for k in ("bin", "ones", "n"))
    model.prior = float(ones.sum() / max(n.sum(), 1))
    lettered = ~np.isnan(x)
    if model.trained and lettered.any():
        model.slope, model.offset = _logistic(x[lettered] / _BINS, ones[lettered], (n - ones)[lettered])
    return model


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MODEL_BYTES) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text, ...).

    `labels` (doc_id, toxic): ids that repeat teach once a row, nulls nothing. Text without a
    letter, or null: the score is the share of toxic rows among those that fit the curve. Labels of
    one class only, or none: every score is that share. A null doc_id is scored and not held out.
    Rows that repeat are scored alike; texts are scored whole, however long. Other columns of
    `docs` are not looked at.
    """
    labels = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id"), FOLDS) != 0)
    known = docs.select("doc_id", "text").join(small_or_not(labels, 40), "doc_id").select("text", "toxic", (fold_of(F.col("doc_id"), CURVE_FOLDS) == CURVE_FOLD).alias("curve"))
    model = fit(known, limit=limit)
    rows = docs.select("doc_id", "text")
    found = with_evidence(rows, model) if model.trained else rows.withColumn("evidence", F.lit(None).cast("double"))
    score = F.when(F.col("evidence").isNull(), model.prior).otherwise(1 / (1 + F.exp(-(model.slope * F.col("evidence") + model.offset))))
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
