"""Prototypes and nearest-prototype naming of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scalar import UNKNOWN, dot, gradient_hash, hamming
from gleaner.operators.durable import written
from gleaner.operators.sizes import BROADCAST_BYTES

MARGIN = 0.12
#: Beyond BROADCAST_BYTES of references: rows that meet one block of them in a task.
ROWS_A_TASK = 1 << 17


def prototypes(vectors: DataFrame, keys: list[str], vector: str = "embedding", least: float = 1e-9) -> DataFrame:
    """Per key the renormalised mean vector, (keys..., proto); keys whose mean is shorter than `least` are dropped."""
    cells = vectors.select(*keys, F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda c: c["m"])
    rows = means.groupBy(*keys).agg(mean.alias("mean")).withColumn("norm", F.sqrt(dot(F.col("mean"), F.col("mean")))).where(F.col("norm") >= least)
    return rows.select(*keys, F.transform("mean", lambda x: x / F.col("norm")).alias("proto"))


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles; a null row is zeros, hashes are one column."""
    if not pa.types.is_list(values.type):
        return values.to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
    ends = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(values), int(ends.max()) if len(ends) else 0))
    out[ends > 0] = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int((ends > 0).sum()), -1)
    return out


def _scores(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Dot products; of hashes the negative Hamming distance."""
    if x.dtype == np.int64:
        return -np.bitwise_count(x.view(np.uint64) ^ refs.view(np.uint64).T).astype(np.float64)
    return x @ refs.T if x.shape[1] == refs.shape[1] else np.zeros((len(x), len(refs)))


def _top(scores: np.ndarray, names: pa.Array, digits: int | None) -> list[pa.Array]:
    """(best name, score, second name, score) of each row; names are in order, and a tie goes to the first."""
    if not len(names):
        return [pa.nulls(len(scores), t) for t in (names.type, pa.float64()) * 2]
    scores = (scores if digits is None else np.round(scores, digits)).copy()
    rows = np.arange(len(scores))
    out: list[pa.Array] = []
    for _ in range(2):
        k = scores.argmax(axis=1)
        top = scores[rows, k]
        out += [names.take(pa.array(k, mask=np.isneginf(top))), pa.array(top, mask=np.isneginf(top))]
        scores[rows, k] = -np.inf
    return out


def two_best(rows: DataFrame, by: list[str], value: str, refs: DataFrame, ref: str, ref_value: str, digits: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(by..., best, top1, second, top2): of each row the two references with the highest scores, as text, and these; a tie goes to the lower reference, by its own type's order.

    Values are vectors (score: dot product) or 64-bit hashes (score: negative Hamming distance).
    `by` must tell rows apart. The references go to every task while their size is within `limit`,
    and this is a map over the rows; beyond, blocks of them meet runs of rows, and a row's blocks are
    brought together by `by`. No references: nulls.
    """
    refs = refs.select(F.col(ref).alias("k"), F.col(ref_value).alias("v"))
    n, size = refs.agg(F.count(F.lit(1)), F.sum(F.size("v") * 8 + 8) if dict(refs.dtypes)["v"].startswith("array") else F.count(F.lit(1)) * 16).first()
    slim = rows.select(*by, F.col(value).alias("_v"))
    name = dict(refs.dtypes)["k"]
    kinds = ", ".join(f"`{c}` {k}" for c, k in slim.drop("_v").dtypes) + f", best {name}, top1 double, second {name}, top2 double"

    def found(batch: pa.RecordBatch | pa.Table, names: pa.Array, known: np.ndarray) -> pa.RecordBatch:
        values = batch.column("_v")
        x = _matrix(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
        columns = [batch.column(c) for c in by] + _top(_scores(x, known), names, digits)
        return (pa.Table if isinstance(batch, pa.Table) else pa.RecordBatch).from_arrays(columns, names=[*by, "best", "top1", "second", "top2"])

    def packed(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        table = table.sort_by("k")
        names = table.column("k").combine_chunks()
        return names.chunk(0) if isinstance(names, pa.ChunkedArray) and names.num_chunks else names, _matrix(table.column("v").combine_chunks())

    as_text = lambda df: df.select(*by, F.col("best").cast("string").alias("best"), "top1", F.col("second").cast("string").alias("second"), "top2")
    if (size or 0) <= limit:
        held = rows.sparkSession.sparkContext.broadcast(packed(refs.toArrow()))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield found(batch, *held.value)

        return as_text(slim.mapInArrow(each, kinds))
    blocks = -(-size // max(limit, 1))
    runs = -(-rows.count() // ROWS_A_TASK)
    left = slim.withColumn("_run", F.pmod(F.xxhash64(*by), F.lit(runs))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = refs.withColumn("_block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    parts = left.groupBy("_block", "_run").cogroup(right.groupBy("_block", "_run")).applyInArrow(lambda a, b: found(a, *packed(b)), kinds)
    pair = lambda score, name: F.struct((-F.col(score)).alias("s"), F.col(name).alias("k"))
    both = parts.groupBy(*by).agg(F.sort_array(F.filter(F.flatten(F.collect_list(F.array(pair("top1", "best"), pair("top2", "second")))), lambda x: x["s"].isNotNull())).alias("t"))
    at = lambda k, f: F.get("t", F.lit(k))[f]
    return as_text(both.select(*by, at(0, "k").alias("best"), (-at(0, "s")).alias("top1"), at(1, "k").alias("second"), (-at(1, "s")).alias("top2")))


def nearest(vectors: DataFrame, protos: DataFrame, by: list[str], key: str = "label", vector: str = "embedding", margin: float = MARGIN, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(by..., best, top1, top2, margin, identity, confidence) of each row of `vectors`; `by` tells rows apart.

    margin: best less second-best cosine, 0 with fewer than two prototypes or for a zero vector;
    identity: the best prototype's key as text, or `unknown` below `margin`; confidence: the margin
    in 0 .. 1 to four digits, kept on abstention.
    """
    out = two_best(vectors, by, vector, protos, key, "proto", limit=limit)
    # A zero vector has the same cosine with all.
    gap = F.coalesce(F.col("top1") - F.col("top2"), F.lit(0.0))
    sure = F.col("margin") >= margin
    out = out.select(*by, "best", "top1", "top2", gap.alias("margin"))
    return out.withColumn("identity", F.when(sure, F.col("best")).otherwise(UNKNOWN)).withColumn("confidence", F.round(F.least(F.greatest(F.col("margin"), F.lit(0.0)), F.lit(1.0)), 4))


#: Prototypes of a block: two blocks meet in a task.
GRAM_BLOCK = 1024
_DIGIT = 16


def _block_cosines(table: pa.Table) -> np.ndarray:
    """Cosines of all pairs of a block, or of two blocks; each pair once."""
    side, x = table.column("_b").to_numpy(), _matrix(table.column("proto").combine_chunks())
    first = side == side.min()
    if first.all():
        return (x @ x.T)[np.triu_indices(len(x), 1)]
    return (x[first] @ x[~first].T).ravel()


def _ordered_keys(values: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles."""
    bits = values.astype(np.float64).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _double_of(key: int) -> float:
    bits = key ^ (1 << 63)
    signed = bits - (1 << 64) if bits >> 63 else bits
    return float(np.array([signed if signed >= 0 else signed ^ 0x7FFFFFFFFFFFFFFF], np.int64).view(np.float64)[0])


def _digit_counts(shift: int, wanted: list[int]) -> Callable[[pa.Table], pa.Table]:
    """Counts (k, digit, n) of the 16 bits from `shift` on, among cosines whose higher bits are wanted[k]."""

    def counted(table: pa.Table) -> pa.Table:
        keys = _ordered_keys(_block_cosines(table))
        high_bits = keys >> np.uint64(shift + _DIGIT) if shift + _DIGIT < 64 else np.zeros(len(keys), np.uint64)
        out: list[tuple[int, int, int]] = []
        for k, prefix in enumerate(wanted):
            digits, many = np.unique((keys[high_bits == np.uint64(prefix)] >> np.uint64(shift)) & np.uint64((1 << _DIGIT) - 1), return_counts=True)
            out += [(k, int(d), int(m)) for d, m in zip(digits, many, strict=True)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"k": pa.array(a, pa.int32()), "digit": pa.array(b, pa.int32()), "n": pa.array(c, pa.int64())})

    return counted


def off_diagonal(protos: DataFrame, key: str = "label", block: int = GRAM_BLOCK) -> DataFrame:
    """Mean, median, 95th percentile, largest and smallest cosine of two different prototypes, each pair both ways; one row.

    Up to `block` prototypes are one task's. Beyond, blocks of them meet two by two; a pair of
    blocks gives sums and counts, and no pair is a row. The percentiles are exact: four passes count the pairs by 16 more bits of their cosine, in
    order, within the values that the wanted ranks have been narrowed to. Fewer than two
    prototypes: nulls.
    """
    slim = written(protos.select(key, "proto"))
    n = slim.count()
    spark, names = slim.sparkSession, ("mean", "median", "p95", "max", "min")
    if n < 2:
        return spark.createDataFrame([(None,) * 5], ", ".join(f"{c} double" for c in names))
    blocks = -(-n // block)
    dealt = slim.select("proto", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.select("proto", "_b", F.least("_b", "_c").alias("_x"), F.greatest("_b", "_c").alias("_y")).groupBy("_x", "_y")

    def whole(table: pa.Table) -> pa.Table:
        c = np.repeat(_block_cosines(table), 2)
        return pa.table({n: pa.array([float(x)]) for n, x in zip(names, (c.mean(), np.median(c), np.percentile(c, 95), c.max(), c.min()), strict=True)})

    if blocks == 1:
        return met.applyInArrow(whole, ", ".join(f"{c} double" for c in names))

    def sums(table: pa.Table) -> pa.Table:
        c = _block_cosines(table)
        return pa.table({"s": pa.array([c.sum()] if c.size else [], pa.float64()), "lo": pa.array([c.min()] if c.size else [], pa.float64()), "hi": pa.array([c.max()] if c.size else [], pa.float64())})

    total, low, high = met.applyInArrow(sums, "s double, lo double, hi double").agg(F.sum("s"), F.min("lo"), F.max("hi")).first()
    pairs = n * (n - 1) // 2
    spots = {q: (2 * pairs - 1) * q for q in (0.5, 0.95)}
    ranks = sorted({r for at in spots.values() for r in (int(at) // 2, min(int(at) + 1, 2 * pairs - 1) // 2)})
    known = {r: (0, r) for r in ranks}  # the bits that are known of the rank's value, and its rank among those that share them
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        wanted = sorted({prefix for prefix, _ in known.values()})

        # At most 65536 counts for each of four ranks.
        rows = met.applyInArrow(_digit_counts(shift, wanted), "k int, digit int, n long").groupBy("k", "digit").agg(F.sum("n").alias("n")).orderBy("k", "digit").collect()
        for r, (prefix, left) in known.items():
            for row in (x for x in rows if wanted[x["k"]] == prefix):
                if left < row["n"]:
                    known[r] = (prefix << _DIGIT | row["digit"], left)
                    break
                left -= row["n"]
    value = {r: _double_of(prefix) for r, (prefix, _) in known.items()}

    def percentile(q: float) -> float:
        at = spots[q]
        a, b = value[int(at) // 2], value[min(int(at) + 1, 2 * pairs - 1) // 2]
        return a + (b - a) * (at - int(at))

    return spark.createDataFrame([(total / pairs, percentile(0.5), percentile(0.95), high, low)], ", ".join(f"{c} double" for c in names))


def vector_hash(vector: Column) -> Column:
    """Gradient hash of a 64-vector as an 8 x 8 grid: 56 bits."""
    return gradient_hash(vector, 8, 7)


def ratio_matches(rows: DataFrame, refs: DataFrame, by: list[str], hash_col: str, ref: str, ref_hash: str, ratio: float = 0.75, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(by..., best, d1, d2, good): the two smallest Hamming distances to `refs`, and whether the first is under `ratio` of the second. `by` tells rows apart."""
    found = two_best(rows, by, hash_col, refs, ref, ref_hash, limit=limit)
    found = found.select(*by, "best", (-F.col("top1")).cast("int").alias("d1"), (-F.col("top2")).cast("int").alias("d2"))
    return found.withColumn("good", F.coalesce(F.col("d1") < ratio * F.col("d2"), F.lit(False)))


def match_counts(pairs: DataFrame, crop: str, entry: str, descriptors: DataFrame, hash_col: str, references: DataFrame, ref_hash: str, ratio: float = 0.75) -> DataFrame:
    """`pairs` (crop, entry) with `matches`: how many of the crop's descriptors are distinctively near to one of the entry's.

    descriptors (crop, hash), references (entry, hash). The two nearest are of the same entry; a
    picture has a few hundred descriptors, which travel as one array.
    """
    packed = references.groupBy(entry).agg(F.collect_list(ref_hash).alias("_r"))
    met = pairs.select(crop, entry).join(descriptors.select(crop, F.col(hash_col).alias("_h")), crop).join(packed, entry)
    two = F.slice(F.sort_array(F.transform("_r", lambda r: hamming(F.col("_h"), r))), 1, 2)
    good = met.select(crop, entry, two.alias("d")).groupBy(crop, entry).agg(F.count_if(F.get("d", F.lit(0)) < ratio * F.get("d", F.lit(1))).alias("matches"))
    return pairs.join(good, [crop, entry], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
