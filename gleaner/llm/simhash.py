"""SimHash near-duplicates by pigeonring filtering.

The 64 bits are cut into a ring of SEGMENTS. If two fingerprints differ in at most DISTANCE bits,
some segment starts a chain whose first l segments differ in at most l * DISTANCE / SEGMENTS bits,
for every l. Over a chain of CHAIN segments this bounds which segments can differ at all; each
largest set that may differ leaves a set of segments that agree. Those are hash-join keys: two
fingerprints that link share at least one. What shares a key is tested along the chain, then by
the whole Hamming distance.

Work is on distinct fingerprints, so exact copies cost one row. Fingerprints that share a key are
met in blocks of bounded size, each pair of blocks in one task, and a block yields a spanning
forest of its links rather than its pairs: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleaner.llm.common import read_table, small_or_not, stored
from gleaner.llm.graph import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 7
CHAIN = 5
#: Fingerprints of one key that meet in a task, at most twice as many for a pair of blocks.
BLOCK = 2048

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes) -> bytes:
    """The SimHash of a text, eight bytes, highest bit first; no words: zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        hashes = digest(line, SEED)
    else:
        hashes = b"".join([digest(line[s : e - 1], SEED) for s, e in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    n = len(rows)
    if n < 128:
        counts = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(rows[:, k], minlength=256) @ _BITS for k in range(8)])
    return np.packbits(2 * counts > n).tobytes()


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    found = b"".join([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts.cast(pa.large_binary())])
    return pa.array(np.frombuffer(found, ">i8").astype(np.int64))


def patterns(distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN) -> list[tuple[int, list[int]]]:
    """(mask of bits that agree, masks of the chain's prefixes) of each chain start and each largest set of differing segments."""
    quota = [length * distance // segments for length in range(chain + 1)]
    fits = [set(d) for r in range(chain + 1) for d in combinations(range(chain), r) if all(sum(x < n for x in d) <= quota[n] for n in range(1, chain + 1))]
    largest = [d for d in fits if not any(d < other for other in fits)]
    cuts = [k * 64 // segments for k in range(segments + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for start in range(segments):
        ring = [masks[(start + k) % segments] for k in range(chain)]
        for d in largest:
            out.append((sum(m for k, m in enumerate(ring) if k not in d), list(accumulate(ring, int.__or__))))
    return out


def _forest(values: np.ndarray, prefixes: list[int], distance: int, segments: int) -> list[tuple[int, int]]:
    """Spanning links, as (value, root), of the values that pass the chain and the Hamming test pairwise."""
    out, left, front = [], values[1:], [values[0]]
    root = values[0]
    while left.size:
        if not front:
            root, left = left[0], left[1:]
            front = [root]
            continue
        diff = left ^ front.pop()
        near = np.ones(left.size, bool)
        for n, mask in enumerate(prefixes, 1):
            near &= np.bitwise_count(diff & np.uint64(mask)) <= n * distance // segments
        near &= np.bitwise_count(diff) <= distance
        if near.any():
            found = left[near]
            out += [(int(v), int(root)) for v in found.view(np.int64)]
            front += list(found)
            left = left[~near]
    return [(a, b - (1 << 64) if b >> 63 else b) for a, b in out]


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """prints (fp long, distinct) -> (a, b): links whose components are those of all pairs within `distance` bits."""
    found = patterns(distance, segments, chain)
    signed = [m - (1 << 64) if m >> 63 else m for m, _ in found]
    keys = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("p"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for k, m in enumerate(signed)])
    keyed = prints.select("fp", F.inline(keys))
    # Counts are summed before they are shuffled, and only keys of several fingerprints gather rows.
    several = stored(keyed.groupBy("p", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    blocks = keyed.join(small_or_not(several, 40), ["p", "m"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    met = (
        blocks.select("p", "m", "fp", "x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"))
        .select("p", "m", "fp", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .repartition("p", "m", "x", "y")
        .groupBy("p", "m", "x", "y")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .where(F.size("fps") > 1)
        .select("p", "fps")
    )
    chains = [prefixes for _, prefixes in found]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            lists = batch.column("fps")
            for p, fps in zip(batch.column("p").to_pylist(), lists, strict=True):
                out += _forest(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), chains[p], distance, segments)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(linked, "a long, b long")


def _clustered(docs: DataFrame, distance: int) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id) of every row; `root` names the component."""
    slim = stored(docs.select("doc_id", fingerprint_of("text").alias("fp"), F.xxhash64("text").alias("text_hash")))
    prints = slim.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = stored(components(links(prints.select("fp"), distance)))
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return slim.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of `docs` (doc_id, text, ...).

    component_id: the smallest doc_id whose fingerprint can be reached by links of at most
    `distance` bits; null where no row of the component has a doc_id. Null, empty and blank texts
    have fingerprint 0 and link to each other. Rows that repeat are returned as often. Empty
    input: no rows. Other columns are not looked at.
    """
    return _clustered(docs, distance).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` that stay: of each component the row with the smallest doc_id, and of those the smallest text hash.

    A row that repeats stays once. Rows without a doc_id stay only where their component has no other.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    stays = _clustered(docs, distance).groupBy("root").agg(first.alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    kept = rows.join(stays, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
