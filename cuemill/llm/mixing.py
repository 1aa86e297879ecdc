"""Mixing sources to target weights.

Each document gets a hash-random key.  Within a source the keys are range-sorted: the leading hex
digits of the key are the range, a window orders the rows of one range, and the sums of the ranges
before it complete the distributed prefix sum.  Every source is cut at its exact budget: whole
epochs first, then the documents in key order, the last of them in part.

Only DataFrame functions are used.  No window ever holds more than one range of one source (1/4096
of its distinct ids, or texts where the id is null), or one row per range or per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._core import WORD, staged, text_of

RANGE_DIGITS = 3
WEIGHTS = (5, 2, 1)


def source_key(column: Column) -> Column:
    """A key without nulls that sorts as the sources do by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("z"))


def source_targets(sizes: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """(s, source_size) -> with target: share of all sizes dealt by weight, none above most times its size.

    Dealing an excess anew until nobody is above ends at min(weight * level, most * size); the level
    follows from the sources sorted by the level at which they are full."""
    rank = F.row_number().over(W.orderBy("s"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    dealt = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    dealt = dealt.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", "s").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("full_at", "s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest_words = F.sum(F.col("source_size")).over(every) * share - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    dealt = dealt.withColumn("try", rest_words / rest_weight)
    level = F.coalesce(F.min(F.when(F.col("try") <= F.col("full_at"), F.struct("full_at", "s", "try"))).over(W.orderBy("full_at", "s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["try"], F.lit(float("inf")))
    return dealt.withColumn("level", level).select("s", "source_size", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep=()) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    The size of a document is its number of words (null text: 0).  Sources in code-point order, null
    last, get the repeating ``weights`` and share ``share`` times all sizes; a target stops at
    ``most`` times its source's size.  Within a source documents are taken in the order of the md5 of
    their id, or of their text where the id is null (ties by id, size, then text), in whole epochs and then up to the exact whole number of words
    below the target.

    Returns doc_id, size, source_size, target, taken and the columns named in ``keep``, one row per
    input row.  Repeated ids are documents of their own, a null id is placed by its text, an
    empty text takes nothing, an empty table gives an empty table.  The same input gives the same
    output.  Other columns are ignored, whatever their names.
    """
    ident = docs[id_col].cast("bigint")
    text = text_of(docs, text_col)
    key = F.md5(F.coalesce(ident.cast("string"), text).cast("binary"))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    kept = [docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = staged(docs.select(ident.alias("doc_id"), source_key(docs[source_col]).alias("s"), key.alias("key"), size.alias("size"), F.xxhash64(text).alias("tie"), *kept), "mix-rows")
    rows = rows.withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    parts = rows.groupBy("s", "part").agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("s").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, share, most, weights)
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    offset = F.sum("part_size").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("part_size")
    placed = parts.withColumn("offset", offset).join(targets, "s").withColumnsRenamed({"s": "ps", "part": "pp"})
    order = W.partitionBy("s", "part").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    out = summed.join(placed, (F.col("s") == F.col("ps")) & (F.col("part") == F.col("pp")))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("inside")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("bigint").alias("taken"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'z') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM {documents}),
z AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY s) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight,
             2.0::DOUBLE * source_size AS cap FROM z),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM z) * 1.5::DOUBLE
              - coalesce(sum(cap) OVER (ORDER BY full_at, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(weight) FROM w)
              - coalesce(sum(weight) OVER (ORDER BY full_at, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS attempt
      FROM f),
t AS (SELECT s, source_size, least(weight * (SELECT arg_min(attempt, (full_at, s)) FROM l WHERE attempt <= full_at), cap) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY d.s ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM d JOIN b ON d.s = b.s)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM p
"""
