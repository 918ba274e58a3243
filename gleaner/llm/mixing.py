"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, their languages and their sources. At each node the
budget is dealt to the children by weight; a child cannot take more than its subtree can supply in
`max_epochs` passes, and what it leaves goes to its siblings by weight. As supply is summed
bottom-up, a shortage is met among siblings first and reaches the ancestors' siblings only if the
whole node is short. A leaf with quota q and supply s gives floor(q / s) whole epochs and, of one
more epoch, the longest prefix of its seeded order that fits in the rest.

The prefix needs no sort of a leaf: the seeded order is the order of a hash, whose first bits cut a
leaf into many bins; only the bin in which the quota ends is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import as_row, columns_of, read_table, small_or_not, stored, words_of

SEED = "mix-1"
MAX_EPOCHS = 2
#: Share of the corpus's tokens that the mixture has.
BUDGET = 0.8
#: Hex digits of the order's hash that tell bins apart: 4096 bins a leaf.
BIN_DIGITS = 3
LEVELS = ("domain", "lang", "source")
#: Relative weights; names that are not listed weigh 1. Sources weigh alike.
WEIGHTS = {"domain": {"web": 4, "books": 3, "forum": 2, "reference": 3, "other": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}


def domain_of(source: Column) -> Column:
    """Five sources a domain, by the number in their name; other names: other."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,6})$", 1).try_cast("int")
    return F.when(n < 5, "web").when(n < 10, "books").when(n < 15, "forum").when(n < 20, "reference").otherwise("other")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _dealt(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent..., name, cap, w, budget of the parent) plus `quota`: water-filling of the budget under the caps.

    Children in order of cap / w: one is full if the budget left by those before it, shared by
    weight among the rest, would give it its cap or more.
    """
    part = Window.partitionBy(*[F.col(p) for p in parent]) if parent else Window.partitionBy(F.lit(1))
    order = part.orderBy(F.col("cap") / F.col("w"), name)
    df = children.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("full", F.col("left") * F.col("w") >= F.col("cap") * F.col("rest_w"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(name).alias("n"), (F.col("left") / F.col("rest_w")).alias("level")))).over(part)["level"]
    return df.withColumn("quota", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w"))).drop("left", "rest_w", "full")


def quotas(supply: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """supply (domain, lang, source, tokens; one row a leaf) -> plus `quota`, whole tokens of the mixture."""
    a, b, c = LEVELS
    leaves = supply.where("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    node2 = leaves.groupBy(a, b).agg(F.sum("cap").alias("cap"))
    node1 = node2.groupBy(a).agg(F.sum("cap").alias("cap"))
    total = supply.agg(F.floor(F.sum("tokens") * budget).cast("double").alias("budget"))
    top = _dealt(node1.withColumn("w", _weight(a, weights)).withColumn("budget", total.scalar()), [], a)
    mid = _dealt(node2.withColumn("w", _weight(b, weights)).join(top.select(a, F.col("quota").alias("budget")), a), [a], b)
    low = _dealt(leaves.withColumn("w", _weight(c, weights)).join(mid.select(a, b, F.col("quota").alias("budget")), [a, b]), [a, b], c)
    return low.select(a, b, c, "tokens", F.floor(F.col("quota") + 1e-6).cast("long").alias("quota"))


def _leaf(docs: DataFrame) -> list[Column]:
    return [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def _order(epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), epoch.cast("string"), key).cast("binary"))


def mixture(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """One row (doc_id, copies, n_tokens, domain, lang, source, epochs_whole) for each doc_id and leaf that is in the mixture.

    docs (doc_id, text, lang, source, ...). Tokens are whitespace-delimited words; texts without a
    word are not in any mixture. Null lang or source: a leaf named ''. Rows that share a doc_id and
    a leaf are one unit, with the sum of their tokens; a null id is an id. `copies`: how many
    epochs have the document, 1 to `max_epochs`. Empty input: no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"), *_leaf(docs)).where("n_tokens > 0")
    slim = stored(rows.groupBy("doc_id", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens")))
    supply = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = stored(
        quotas(supply, budget, max_epochs, weights)
        .withColumn("whole", F.least(F.expr("quota div tokens"), F.lit(max_epochs)).cast("int"))
        .withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens"))
    )
    ordered = slim.join(small_or_not(plan, 200), list(LEVELS)).withColumn("o", _order(F.col("whole"), key))
    ordered = ordered.withColumn("bin", F.substring("o", 1, BIN_DIGITS))
    bins = ordered.groupBy(*LEVELS, "bin", "rest").agg(F.sum("n_tokens").alias("in_bin"))
    upto = bins.withColumn("upto", F.sum("in_bin").over(Window.partitionBy(*LEVELS).orderBy("bin")))
    # The last bin of a leaf that fits whole, and what is left for the next one.
    edge = upto.where("upto <= rest").groupBy(*LEVELS).agg(F.max("bin").alias("last_bin"), F.max("upto").alias("fits"))
    ends = plan.select(*LEVELS).join(edge, list(LEVELS), "left")
    placed = ordered.join(small_or_not(ends, 200), list(LEVELS)).select(ordered["*"], "last_bin", F.coalesce("fits", F.lit(0)).alias("fits"))
    nxt = upto.where("upto > rest").groupBy(*LEVELS).agg(F.min("bin").alias("next_bin"))
    placed = placed.join(small_or_not(nxt, 200), list(LEVELS), "left")
    sure = placed.where("bin <= last_bin").select("doc_id", *LEVELS, "n_tokens", "whole", F.lit(1).alias("part"))
    edge_rows = placed.where("bin = next_bin").withColumn("upto", F.col("fits") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("o", "doc_id")))
    ranked = edge_rows.select("doc_id", *LEVELS, "n_tokens", "whole", (F.col("upto") <= F.col("rest")).cast("int").alias("part"))
    later = placed.where("bin > next_bin").select("doc_id", *LEVELS, "n_tokens", "whole", F.lit(0).alias("part"))
    found = sure.unionByName(ranked).unionByName(later)
    return found.select("doc_id", (F.col("whole") + F.col("part")).cast("int").alias("copies"), "n_tokens", *LEVELS, F.col("whole").alias("epochs_whole")).where("copies > 0")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in the mixture, each as often as it has copies; columns of `docs`, whatever their names."""
    chosen = mixture(docs, **options).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "copies")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"), as_row(docs))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))
    out = rows.where("worded").join(chosen, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*columns_of("row", docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))


MIXING_SQL = """
WITH units AS (
  SELECT doc_id, CASE WHEN n < 5 THEN 'web' WHEN n < 10 THEN 'books' WHEN n < 15 THEN 'forum' WHEN n < 20 THEN 'reference' ELSE 'other' END AS domain,
         lang, source, sum(t) AS n_tokens
  FROM (SELECT doc_id, TRY_CAST(regexp_extract(coalesce(source, ''), '^src([0-9]{1,6})$', 1) AS INT) AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS t FROM documents)
  WHERE t > 0 GROUP BY ALL),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 2 * sum(n_tokens)::DOUBLE AS cap, 1.0::DOUBLE AS w FROM units GROUP BY ALL),
mid AS (SELECT domain, lang, sum(cap) AS cap, (CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END)::DOUBLE AS w FROM leaf GROUP BY ALL),
top AS (SELECT domain, sum(cap) AS cap, (CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 WHEN 'reference' THEN 3 ELSE 1 END)::DOUBLE AS w,
               (SELECT floor(sum(tokens) * 0.8) FROM leaf) AS budget FROM mid GROUP BY domain),
top1 AS (SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM top),
topq AS (SELECT domain, CASE WHEN l * w >= cap * r THEN cap ELSE w * (SELECT arg_min(l / r, cap / w) FROM top1 WHERE l * w < cap * r) END AS budget FROM top1),
mid1 AS (SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM mid JOIN topq USING (domain)),
midl AS (SELECT domain, arg_min(l / r, cap / w) AS level FROM mid1 WHERE l * w < cap * r GROUP BY domain),
midq AS (SELECT domain, lang, CASE WHEN l * w >= cap * r THEN cap ELSE level * w END AS budget FROM mid1 LEFT JOIN midl USING (domain)),
low1 AS (SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
                sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM leaf JOIN midq USING (domain, lang)),
lowl AS (SELECT domain, lang, arg_min(l / r, cap / w) AS level FROM low1 WHERE l * w < cap * r GROUP BY domain, lang),
quota AS (SELECT domain, lang, source, tokens::BIGINT AS tokens, floor((CASE WHEN l * w >= cap * r THEN cap ELSE level * w END) + 1e-6)::BIGINT AS quota
          FROM low1 LEFT JOIN lowl USING (domain, lang)),
plan AS (SELECT *, least(quota // tokens, 2) AS whole FROM quota),
placed AS (SELECT u.*, p.whole, p.quota - p.whole * p.tokens AS rest,
                  sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1/' || p.whole || '/' || coalesce(doc_id::VARCHAR, '')), doc_id ROWS UNBOUNDED PRECEDING) AS upto
           FROM units u JOIN plan p USING (domain, lang, source))
SELECT doc_id, (whole + (upto <= rest)::INT)::INT AS copies, n_tokens::BIGINT AS n_tokens, domain, lang, source, whole::INT AS epochs_whole
FROM placed WHERE whole + (upto <= rest)::INT > 0
"""
