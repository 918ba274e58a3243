"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Each text becomes its word unigrams and bigrams, hashed into a fixed number of slots. Two
multinomials over the slots are counted over every row: one of the rows that are trusted, one of
the whole corpus. A text's score is the mean log ratio of the two over its n-grams; a text is kept
if it passes the base rules and its score reaches a fixed threshold. Scoring is a map over rows:
the slot weights, whose number is a parameter, reach the tasks as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import as_row, columns_of, SPACE_RUN, read_table, small_or_not, words_of

#: The weights, four bytes a slot, go with each row.
SLOTS = 1 << 16
SMOOTHING = 0.5
#: Mean log ratio, in nats an n-gram, from which a text counts as like the target.
THRESHOLD = -0.15
SYMBOLS = "#*$%&|<>"


def _slot(*words: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(slots)).cast("int")


def slot_counts(docs: DataFrame, trusted: Column, slots: int = SLOTS) -> DataFrame:
    """Per slot: `raw`, n-grams of all rows, and `target`, those of rows where `trusted` holds (null: does not)."""
    words = docs.select(words_of(F.col("text")).alias("w"), F.coalesce(trusted, F.lit(False)).alias("good"))
    pairs = words.select("good", F.explode(F.arrays_zip("w", F.expr("slice(w, 2, size(w))").alias("x"))).alias("p")).select("good", "p.w", "p.x")
    grams = pairs.select("good", F.explode(F.array(_slot("w", slots=slots), F.when(F.col("x").isNotNull(), _slot("w", "x", slots=slots)))).alias("slot"))
    return grams.where("slot is not null").groupBy("slot").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))


def slot_weights(counts: DataFrame, slots: int = SLOTS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, `weights`: the log ratio of each slot, in slot order. Its length is `slots` at any corpus size."""
    spine = counts.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    row = (
        spine.join(counts, "slot", "left")
        .na.fill(0, ["raw", "target"])
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("slot", "raw", "target"))).alias("all"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    )
    a, mass = F.lit(smoothing), F.lit(smoothing * slots)
    return row.select(F.transform("all", lambda s: F.log((s["target"] + a) / (F.col("t") + mass)) - F.log((s["raw"] + a) / (F.col("r") + mass))).cast("array<float>").alias("weights"))


def _let(name: str, value: str, body: str) -> str:
    """SQL: `body` with `value`, computed once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def judgement(text: str, weights: str, slots: int, threshold: float) -> str:
    """SQL of a text's measures and verdict, a struct; `text` and `weights` are columns.

    All in one expression, so that a filter on the verdict costs no second look at the text.
    n_repeat_words compares three-word windows by a 64-bit hash: windows are sorted by hash, those
    equal to a neighbour are put in order of place, and each covers three words less what the next
    one covers again.
    """
    space = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
    words = f"array_remove(split(t, '{SPACE_RUN}'), '')".replace("\\", "\\\\")
    hashes = "if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"
    twice = _let("s", "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))", "sort_array(transform(filter(s, (e, k) -> e.x <=> get(s, k - 1).x or e.x <=> get(s, k + 1).x), e -> e.i))")
    starts = f"if(size(array_distinct(h)) = size(h), cast(array() as array<int>), {twice})"
    covered = _let("p", starts, "aggregate(transform(p, (q, k) -> least(3, coalesce(get(p, k + 1) - q, 3))), 0L, (a, x) -> a + x)")
    one, two = f"v[cast(pmod(xxhash64(w[i]), {slots}) as int)]", f"v[cast(pmod(xxhash64(w[i], w[i + 1]), {slots}) as int)]"
    ratio = f"if(size(w) = 0, 0D, aggregate(sequence(0, size(w) - 1), 0D, (a, i) -> a + {one} + if(i + 1 < size(w), {two}, 0D)) / (2 * size(w) - 1))"
    of_words = _let("w", words, _let("v", weights, f"named_struct('n_words', cast(size(w) as bigint), 'n_repeat_words', {_let('h', hashes, covered)}, 'llr', {ratio})"))
    lines = _let("l", f"filter(split(t, '\\\\n'), x -> length(translate(x, {space}, '')) > 0)", "cast(size(l) - size(array_distinct(l)) as bigint)")
    verdict = (
        f"named_struct('n_words', m.n_words, 'word_chars', cast(length(translate(t, {space}, '')) as bigint), 'n_symbols', cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint),"
        f" 'n_dup_lines', {lines}, 'n_repeat_words', m.n_repeat_words, 'base_failed', m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words, 'llr', m.llr,"
        f" 'kept', not (m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words) and m.llr >= {threshold})"
    )
    return _let("t", f"coalesce({text}, '')", _let("m", of_words, verdict))


def _weighted(docs: DataFrame, trusted: DataFrame, slots: int) -> DataFrame:
    """(row, text, weights) of `docs`: its columns as one, and the slot weights."""
    ids = small_or_not(trusted.select("doc_id").where("doc_id is not null").distinct(), 40).withColumn("_good", F.lit(True))
    weights = slot_weights(slot_counts(docs.select("doc_id", "text").join(ids, "doc_id", "left"), F.col("_good"), slots), slots)
    return docs.select(as_row(docs), "text", weights.scalar().alias("weights"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def quality(docs: DataFrame, trusted: DataFrame, slots: int = SLOTS, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every row of `docs` (doc_id, text, ...): its columns plus the base measures, `llr` and `kept`.

    `trusted` (doc_id) names the rows of the target; ids that repeat count once, null ids never.
    No words, or null text: llr 0 and base_failed. No trusted row at all: the target is uniform and
    the same threshold holds. Repeated rows are judged alike and all returned. Columns of `docs`
    whose names clash with the result's are replaced.
    """
    docs = docs.drop(*MEASURES)
    judged = _weighted(docs, trusted, slots).select("row", F.expr(judgement("text", "weights", slots, threshold)).alias("j"))
    return judged.select(*columns_of("row", docs.columns), *[F.col("j")[m].alias(m) for m in MEASURES])


def kept_rows(docs: DataFrame, trusted: DataFrame, slots: int = SLOTS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with their own columns."""
    verdict = F.expr(f"filter(array({judgement('text', 'weights', slots, threshold)}), j -> j.kept)")
    return _weighted(docs, trusted, slots).select("row", F.explode(verdict)).select(*columns_of("row", docs.columns))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
