"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts.

Every document gets a hash-random key (md5 of seed and id), and a source's documents are ranged by it. A
source takes whole epochs while its budget lasts, and of the epoch that does not fit the documents in key
order up to a cut. Prefix sums find the cut in three steps: over the totals of 4096 ranges of keys, over
those of 4096 ranges inside the one that holds the cut, and over the sorted documents of the last range.
So no task sorts or sums more than 4096 rows of a source and the documents of one in 16 million ranges,
however many rows a source has; rows combine before each exchange. One row by source (its epochs and its cut)
then decides every document where it lies: texts are never exchanged. The document at the cut is taken in part.

Defined results: null text has size 0 and takes 0; null source is a source of its own, last in
order; ties of keys go by doc_id (null first) and size, and rows that share all three by a hash of the text;
identical rows are interchangeable, so their multiset of results is fixed; no rows give no rows; other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaflow.llm.common import discard, stash

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # of the key by step: 4096 ranges


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets by source: weights repeat over the sources in code point order, null last; each target is
    min(most * size, level * weight), with the one level at which all targets sum to share * total.

    `sizes` has one row per source (source, source_size). Sources are few against documents; the
    level search is a running sum over sources ordered by the level at which each one fills up."""
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights)).cast("int") + 1)
    filled = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("at").asc())
    whole = Window.partitionBy()
    level = (
        filled.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    found = level.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "at", "level"))).over(whole)["level"])
    return found.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def _before(size: str, by: tuple[str, ...], order: list[Column]) -> Column:
    return F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def source_cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, source_size, target, epochs, and the cut: the row (key, doc_id, size; n rows share it) at which the
    rest of the budget ends, and the words left for it. The cut is null for sources without words.

    rows: source, key, doc_id, size; budgets: one row by source with source_size, target, epochs, rest."""
    # `left` is what the budget has left at the start of the range that holds the cut
    found = budgets.select("source", F.lit("").alias("range"), F.col("rest").alias("left"))
    for step in (1, 2):
        deeper = rows.alias("r").join(found.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & F.col("r.key").startswith(F.col("f.range")))
        totals = deeper.groupBy("r.source", F.substring("r.key", 1, step * DIGITS).alias("range"), "f.left").agg(F.sum("r.size").alias("size"))
        summed = totals.withColumn("before", _before("size", ("source",), [F.col("range")]))
        found = stash(summed.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("size"))).select("source", "range", (F.col("left") - F.col("before")).alias("left")), "mix-range", few=True)
    last = rows.alias("r").join(found.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & F.col("r.key").startswith(F.col("f.range")))
    ties = last.groupBy("r.source", "key", "doc_id", "size", "left").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("size") * F.col("n"))
    summed = ties.withColumn("before", _before("words", ("source",), [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size")]))
    cut = summed.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    cut = cut.select("source", F.struct("key", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size").alias("cut"), "n", (F.col("left") - F.col("before")).alias("left"))
    joined = budgets.alias("b").join(cut.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")), "left")
    return joined.select("b.source", "source_size", "target", "epochs", "cut", "n", "left")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, and the columns of `keep` under their names.

    taken / size is the number of epochs of a document; a source's taken words sum to floor(target)."""
    kept = [f"kept_{i}" for i in range(len(keep))]
    whole = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), random_key(F.col("doc_id"), seed).alias("key"),
        F.xxhash64("text").alias("text_hash"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)],
    )
    rows = stash(whole.select("doc_id", "source", "size", "key", "text_hash"), "mix-sizes", few=True)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    budgets = targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    # one row by source, written, so that Spark knows its size when it chooses the joins
    budgets = stash(budgets, "mix-budgets", few=True)
    cuts = stash(source_cuts(rows, budgets), "mix-cuts", few=True)
    discard(budgets)
    own = F.struct("key", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")

    def decided(d: DataFrame) -> DataFrame:
        return d.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select("d.*", "source_size", "target", "epochs", "cut", "n", "left")

    # with `keep` the documents are gone through again instead of being written a second time
    placed = decided(whole if keep else rows)
    tied = F.coalesce(own.eqNullSafe(F.col("cut")) & (F.col("n") > 1), F.lit(False))
    part = F.when(F.col("cut").isNull(), F.lit(0)).when(own < F.col("cut"), F.col("size")).when(own.eqNullSafe(F.col("cut")), F.least(F.col("size"), F.col("left"))).otherwise(F.lit(0))
    out = placed.withColumn("part", part)
    if not cuts.where("n > 1").isEmpty():  # rows that share the cut's key, id and size stand in line
        line = F.row_number().over(Window.partitionBy("source").orderBy("text_hash")) - 1
        shared = placed.where(tied).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - line * F.col("size"))))
        out = out.where(~tied).unionByName(shared)
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, row(cap / weight, place)) AS final FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, coalesce(least(cap, final * weight), cap) AS target FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
