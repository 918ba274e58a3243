"""Line dedup by an exact set-similarity join.

A line is the set of its words in lower case; a word is a 63-bit id, its rarity above its hash.
Lines of the same set are one class. Rarity is how many words of the corpus fall into the slot of
the hash; any order gives the same result, a good one short lists. Two sets of Jaccard 0.8 or more
share a word among the first n - ceil(0.8 n) + 1 of each, and what they share begins at the first
such word: so a pair belongs to that word, and to be met there both must have enough words left.
Postings know a word by the upper half of its id: words that share it only make sets meet in vain.

Pairs are never rows. Of all postings, those remain that some other of their word may link to by
length, position and a bitmap of the words (a semi-join), then those of whose partners one shares
no earlier word (another). What is left gets its whole word set, and meets in blocks of bounded
weight, every pair of blocks of a word; a block gives, for each class, how many it links to and the
earliest line of these, and the blocks' counts are added up.

A line goes if an earlier one (by document id, line number, text) has Jaccard 0.8 or more with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_BYTES, SPACES, as_row, read_table, small_or_not, stored

#: Rarity is told by the slot of a word's hash, eight bytes each: a power of two, about a quarter of the vocabulary or more.
SLOTS = 1 << 16
#: Jaccard threshold NUM / DEN, so that an overlap o of sizes m and n suffices if (NUM + DEN) * o >= NUM * (m + n).
NUM, DEN = 4, 5
#: Words of the sets of a block, of which two meet in a task (a larger set is a block of its own).
BLOCK_WORDS = 1 << 15
#: From the first size on a set has 128 bits instead of 64, from the second also a bitmap of WIDE longs.
LINE_OF_128, LONG_LINE, WIDE = 96, 128, 8


def slot_ranks(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row, `ranks`: of each slot, the binary logarithm of the number of words in it, 0 to 31, as the upper bits of an id."""
    words = docs.select(F.lower("text").alias("text")).select(F.explode(_words(F.col("text"))).alias("w")).where("w <> ''")
    counts = words.groupBy(_slot(F.xxhash64("w"), slots).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    spine = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    rank = F.least(F.lit(31), F.floor(F.log2(F.coalesce("n", F.lit(1))))).cast("long")
    return spine.join(counts, "slot", "left").select("slot", F.shiftleft(rank, 58).alias("rank")).groupBy().agg(F.sort_array(F.collect_list(F.struct("slot", "rank"))).alias("r")).select(F.col("r.rank").alias("ranks"))


def _spaced(text: Column) -> Column:
    """The text with single spaces for white space within lines; most texts have none of it, and one look tells."""
    out, spaces = text, SPACES.replace(" ", "").replace("\n", "")
    for space in spaces:
        out = F.replace(out, F.lit(space), F.lit(" "))
    found = F.contains(text, F.lit(spaces[0]))
    for space in spaces[1:]:
        found = found | F.contains(text, F.lit(space))
    return F.when(found, out).otherwise(text)


def _words(text: Column) -> Column:
    """The words of a text, with empty ones between them: cut at single spaces, which takes no pattern."""
    return F.split(F.replace(_spaced(text), F.lit("\n"), F.lit(" ")), " ")


def _slot(h: Column, slots: int) -> Column:
    return h.bitwiseAND(F.lit(slots - 1)).cast("int")


def _text_lines(text: Column) -> Column:
    """The lines of a text, their words apart by spaces only."""
    return F.split(_spaced(text), "\n")


def _ids(line: Column, ranks: Column, slots: int) -> Column:
    """The set of word ids of a line of `_text_lines`, rarest first."""

    def coded(h: Column) -> Column:
        return F.get(ranks, _slot(h, slots)).bitwiseOR(F.shiftrightunsigned(h, 6))

    hashes = F.transform(F.array_remove(F.split(F.lower(line), " "), ""), lambda w: F.xxhash64(w))
    # A set once all is coded, not before: different hashes may have the same id.
    return F.sort_array(F.array_distinct(F.transform(hashes, coded)))


def _toggled(ids: Column, part: int, parts: int) -> Column:
    """64 of 64 * `parts` bits, of which each word toggles one."""

    def toggle(bits: Column, x: Column) -> Column:
        one = (F.shiftright(x, 6).bitwiseAND(F.lit(parts - 1)) == part).cast("long")
        return bits.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(ids, F.lit(0).cast("long"), toggle)


def _bits(ids: Column, second_from: int = 0) -> list[Column]:
    """128 bits, of which each word toggles one: as the halves' sum without carry, and the second half (null for sets below `second_from`)."""

    def toggled(one: Callable[[Column], Column]) -> Column:
        return F.aggregate(ids, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", one(x), x.bitwiseAND(F.lit(63)).cast("int"))))

    second = F.when(F.size(ids) >= second_from, toggled(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1))))
    return [toggled(lambda x: F.lit(1).cast("long")).alias("bits0"), second.alias("bits1")]


def _bits_may_link(a: Callable[[str], Column], b: Callable[[str], Column], sizes: Column) -> Column:
    """As many bits differ as words at most that one has and the other lacks; without a second half, the sum's bits are told apart."""
    both, second = (a(k).bitwiseXOR(b(k)) for k in ("bits0", "bits1"))
    differ = F.coalesce(F.bit_count(both.bitwiseXOR(second)) + F.bit_count(second), F.bit_count(both))
    return (NUM + DEN) * differ <= (DEN - NUM) * sizes


def _lines(docs: DataFrame, ranks: DataFrame, slots: int) -> DataFrame:
    """(doc_id, line, text_hash, chars, ids) of every line that has a word."""
    # Beside an explode, an expression is computed once a line: the text's hash comes before it, the ranks after it.
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = hashed.select("doc_id", "text_hash", F.posexplode(_text_lines(F.col("text"))).alias("line", "x")).where(F.trim("x") != "")
    return rows.withColumn("_ranks", ranks.scalar()).select("doc_id", "line", "text_hash", F.length("x").alias("chars"), _ids(F.col("x"), F.col("_ranks"), slots).alias("ids"))


def _signature() -> list[Column]:
    return [F.xxhash64("ids").alias("s1"), F.hash("ids").alias("s2"), F.size("ids").alias("n")]


def _classes(docs: DataFrame, ranks: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """(lines with their class's signature, classes with a number `c`, place, size, bitmap and prefix)."""
    first = F.slice("ids", F.lit(1), F.expr(f"size(ids) - (({NUM} * size(ids) + {DEN - 1}) div {DEN}) + 1").cast("int"))
    prefix = F.transform(first, lambda x: F.shiftright(x, 32).cast("int"))
    bits = _bits(F.col("ids"), LINE_OF_128)
    lines = stored(_lines(docs, ranks, slots).select("doc_id", "line", "text_hash", "chars", *_signature(), *bits, prefix.alias("prefix")))
    place = F.min(F.struct("doc_id", "line", "text_hash")).alias("place")
    # Few lines are copies: they go to their class's task at once, and are sorted there only.
    classes = lines.repartition("s1").groupBy("s1", "s2", "n").agg(place, *[F.first(x).alias(x) for x in ("bits0", "bits1", "prefix")])
    return lines.drop("bits0", "bits1", "prefix"), stored(classes.withColumn("c", F.monotonically_increasing_id()))


def _may_link() -> Column:
    """Of two classes that share a word and none before it: what length, positions and bitmap allow."""
    need = NUM * (F.col("a.n") + F.col("b.n"))
    length = (DEN * F.col("a.n") >= NUM * F.col("b.n")) & (DEN * F.col("b.n") >= NUM * F.col("a.n"))
    room = (NUM + DEN) * F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= need
    near = _bits_may_link(lambda k: F.col(f"a.{k}"), lambda k: F.col(f"b.{k}"), F.col("a.n") + F.col("b.n"))
    return (F.col("a.c") != F.col("b.c")) & length & room & near


def _met(classes: DataFrame) -> DataFrame:
    """(word, c, at): postings with a partner that `_may_link` allows."""
    postings = classes.select("n", "bits0", "bits1", "c", F.posexplode("prefix").alias("at", "word"))
    # In the order of the table, under aliases only: both sides are one exchange.
    return postings.alias("a").join(postings.alias("b"), (F.col("a.word") == F.col("b.word")) & _may_link(), "left_semi").select("word", "c", "at")


def _whole_sets(docs: DataFrame, ranks: DataFrame, slots: int, wanted: DataFrame) -> DataFrame:
    """(c, ids) of the `wanted` classes (c, place), from the lines at their places: no other line is coded again."""
    by_text = wanted.groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(F.struct("c", "place.line")).alias("wanted"))
    if wanted.count() * 48 <= BROADCAST_BYTES:
        by_text = F.broadcast(by_text)
    found = docs.withColumn("text_hash", F.xxhash64("text")).join(by_text, ["doc_id", "text_hash"])
    lines = found.select("wanted", _text_lines(F.col("text")).alias("lines")).select(F.inline("wanted"), "lines")
    lines = lines.select("c", F.get("lines", F.col("line")).alias("x"), ranks.scalar().alias("_ranks"))
    # A row that repeats has its lines as often.
    return lines.select("c", _ids(F.col("x"), F.col("_ranks"), slots).alias("ids")).dropDuplicates(["c"])


def _owners(met: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(word, c, n, at, earlier): postings with a partner that may link and has no earlier word in common."""
    by_class = met.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    known = classes.select("c", "n", "bits0", "bits1").join(by_class, "c").join(sets, "c")
    wide = F.when(F.col("n") >= LONG_LINE, F.array(*[_toggled(F.col("ids"), k, WIDE) for k in range(WIDE)]))
    known = known.select("c", "n", "bits0", "bits1", wide.alias("wide"), F.col("w.word").alias("words"), "w")
    placed = known.select("c", "n", "bits0", "bits1", "wide", "words", F.posexplode("w").alias("k", "x"))
    postings = stored(placed.select("x.word", "c", "n", "bits0", "bits1", "wide", "x.at", F.slice("words", F.lit(1), F.col("k")).alias("earlier")))
    far = sum((F.bit_count(F.get("a.wide", F.lit(k)).bitwiseXOR(F.get("b.wide", F.lit(k)))) for k in range(WIDE)), F.lit(0))
    near = F.coalesce((NUM + DEN) * far <= (DEN - NUM) * (F.col("a.n") + F.col("b.n")), F.lit(True))
    first = ~F.arrays_overlap("a.earlier", "b.earlier")
    return postings.alias("a").join(postings.alias("b"), (F.col("a.word") == F.col("b.word")) & _may_link() & near & first, "left_semi").select("word", "c", "n", "earlier")


def _counts(owners: DataFrame, classes: DataFrame, sets: DataFrame, block_words: int) -> DataFrame:
    """(c, n_links, earliest): of each class that has any."""
    weights = owners.groupBy("word").agg(F.sum("n").alias("weight")).where(F.col("weight") > block_words)
    cut = small_or_not(stored(weights.select("word", F.ceil(F.col("weight") / block_words).cast("int").alias("blocks"))), 32)
    dealt = owners.join(cut, "word", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    whole = dealt.join(sets, "c").join(classes.select("c", "place", "bits0", "bits1"), "c")
    meets = whole.select("word", "c", "n", "place", "bits0", "bits1", "ids", "earlier", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    blocks = meets.groupBy("word", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.collect_list(F.struct("c", "n", "place", "bits0", "bits1", "ids", "earlier", "own")).alias("all")).where(F.size("all") > 1)

    def links(a: Column, b: Column) -> Column:
        apart = (a["c"] != b["c"]) & ((F.col("x") == F.col("y")) | (a["own"] != b["own"]))
        sizes = a["n"] + b["n"]
        near = (DEN * a["n"] >= NUM * b["n"]) & (DEN * b["n"] >= NUM * a["n"])
        # Of sets that link, few words are in one only: these are gathered, not those in both.
        shared = a["n"] - F.size(F.array_except(a["ids"], b["ids"]))
        return near & _bits_may_link(lambda k: a[k], lambda k: b[k], sizes) & apart & ~F.arrays_overlap(a["earlier"], b["earlier"]) & ((NUM + DEN) * shared >= NUM * sizes)

    def linked(a: Column) -> Column:
        partners = F.transform(F.filter("all", lambda b: links(a, b)), lambda b: b["place"])
        return F.struct(a["c"].alias("c"), partners.alias("p"))

    found = blocks.select(F.inline(F.transform(F.transform("all", linked), lambda r: F.struct(r["c"].alias("c"), F.size(r["p"]).alias("k"), F.array_min(r["p"]).alias("first")))))
    return found.where("k > 0").groupBy("c").agg(F.sum("k").alias("n_links"), F.min("first").alias("earliest"))


def similar_lines(docs: DataFrame, slots: int = SLOTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row (doc_id, line, text_hash, chars, removed, n_links) for each line of `docs` (doc_id, text) that has a word.

    n_links: how many other word sets of the corpus are similar to the line's; lines of the same
    set are not links but copies, of which the first alone may stay. Rows that share an id are told
    apart by the hash of their texts; of rows that repeat, a line that stays does in each. Null
    ids: left out. Null texts, blank lines and empty input give no rows. Very long lines are sets
    like any.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    ranks = stored(slot_ranks(docs, slots))
    lines, classes = _classes(docs, ranks, slots)
    met = stored(_met(classes))
    wanted = classes.join(met.select("c").distinct(), "c", "left_semi").select("c", "place")
    sets = stored(_whole_sets(docs, ranks, slots, stored(wanted)))
    counts = _counts(stored(_owners(met, classes, sets)), classes, sets, block_words)
    known = classes.select("s1", "s2", "n", "place", "c").join(stored(counts), "c", "left")
    found = lines.join(known, ["s1", "s2", "n"])
    first = F.struct("doc_id", "line", "text_hash") == F.col("place")
    return found.select("doc_id", "line", "text_hash", "chars", (~first | F.coalesce(F.col("earliest") < F.col("place"), F.lit(False))).alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicated_lines(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`docs` (doc_id, text, ...) with `text` less its removed lines; lines without a word stay. Rows with a null id stay as they are."""
    gone = similar_lines(docs, slots).where("removed").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("line").alias("_gone"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), as_row(docs))
    out = rows.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    text = F.col("row")["text"]
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return out.select(*[F.when(F.col("_gone").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    by_doc = similar_lines(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sum("n_links").alias("n_links"), F.sum(F.when(~F.col("removed"), F.col("chars")).otherwise(0)).alias("kept_chars")
    )
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_removed", "n_links", "kept_chars")])


LINES_SQL = """
WITH l AS (
  SELECT doc_id, line, length(content) AS chars, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
s AS (SELECT * FROM l WHERE len(w) > 0),
c AS (SELECT w, len(w) AS n, min(doc_id * 1000000 + line) AS place FROM s GROUP BY w),
t AS (SELECT place, n, unnest(w) AS token FROM c),
f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
r AS (SELECT place, n, token, row_number() OVER (PARTITION BY place ORDER BY df, token) AS k FROM t JOIN f USING (token)),
p AS (SELECT * FROM r WHERE k <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.place AS a, b.place AS b FROM p a JOIN p b ON a.token = b.token AND a.place < b.place AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
links AS (SELECT a, b FROM cand JOIN c ca ON ca.place = a JOIN c cb ON cb.place = b WHERE 9 * len(list_intersect(ca.w, cb.w)) >= 4 * (ca.n + cb.n)),
sides AS (SELECT a AS place, b AS other FROM links UNION ALL SELECT b, a FROM links),
linked AS (SELECT place, count(*) AS n_links, min(other) AS earliest FROM sides GROUP BY place),
m AS (SELECT s.doc_id, s.chars, (s.doc_id * 1000000 + s.line <> c.place OR coalesce(earliest < c.place, FALSE)) AS removed, coalesce(n_links, 0) AS n_links
      FROM s JOIN c ON s.w = c.w LEFT JOIN linked ON linked.place = c.place),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed, sum(n_links) AS n_links, sum(CASE WHEN removed THEN 0 ELSE chars END) AS kept_chars FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(g.n_links, 0)::BIGINT AS n_links, coalesce(kept_chars, 0)::BIGINT AS kept_chars
FROM (SELECT doc_id FROM documents) d LEFT JOIN g USING (doc_id)
"""
